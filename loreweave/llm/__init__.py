"""Training-data operators. Nothing else in loreweave imports this subpackage."""
