"""The labelled table of the main-text tree: pages of many layouts, whose blocks are marked by hand.

{+n} stands for n words of a block that a reader takes for main text, {-n} for n words of one that they do not; {+} and {-} mark
a block whose words are written out. Every page is read at several lengths, since the same layout holds short and long texts.
"""

PAGES = (
    # a blog, everything in named divs
    """<body><div id="masthead" class="site-header"><a href=/>{-2}</a><p>{-6}</p></div><div class="main-navigation"><ul><li><a href=/>{-}Home</a></li><li><a href=/a>{-}About us</a></li><li><a href=/c>{-1}</a></li></ul></div>
    <div id="content"><div class="post"><h1>{+7}</h1><div class="meta">{-}Posted by Ann on May 3</div><p>{+60}</p><p>{+45}</p><h2>{+4}</h2><p>{+80}</p><ul><li>{+9}</li><li>{+12}</li><li>{+5}</li></ul><p>{+30} <a href=x>{+3}</a> {+10}</p></div>
    <div id="comments"><h3>{-}3 comments</h3><ol><li><p>{-25}</p></li><li><p>{-40}</p></li><li><p>{-8}</p></li></ol><form><label>{-}Your name</label><button>{-}Send</button></form></div></div>
    <div id="sidebar"><h3>{-2}</h3><ul><li><a href=1>{-5}</a></li><li><a href=2>{-6}</a></li></ul><p>{-18}</p></div><div id="footer"><p>{-}Copyright 2020 Example Inc.</p><p>{-14}</p></div></body>""",
    # a news site with article, header, aside and footer elements
    """<body><header><div>{-3}</div><nav><a href=1>{-1}</a><a href=2>{-1}</a><a href=3>{-2}</a></nav></header><main><article><header><h1>{+9}</h1><p>{+14}</p></header><figure><figcaption>{+8}</figcaption></figure><p>{+55}</p><p>{+3}</p><blockquote>{+20}</blockquote><p>{+70}</p>
    <aside><h4>{-}Related stories</h4><a href=1>{-7}</a></aside><p>{+50}</p><footer><a href=t>{-1}</a><a href=t>{-1}</a></footer></article></main><aside><h3>{-}Most read</h3><p><a href=1>{-8}</a></p><p><a href=2>{-9}</a></p></aside><footer><p>{-20}</p><p>{-}All rights reserved</p></footer></body>""",
    # one page as generators write it: a short article, an advert as long as the text
    """<body><nav><ul><li><a href=1>{-1}</a></li><li><a href=2>{-1}</a></li><li><a href=3>{-1}</a></li></ul></nav><div class="ad">{-9}</div><article><h1>{+2}</h1><p>{+2}</p></article><footer>{-10}</footer></body>""",
    """<body><nav><ul><li><a href=1>{-1}</a></li><li><a href=2>{-1}</a></li></ul></nav><div class="ad">{-12}</div><article><h1>{+10}</h1><p>{+10}<br></p><p>{+40}</p><p>{+5}</p><p>{+90}</p><p>{+2}</p></article><footer>{-14}</footer></body>""",
    # bare divs, no names at all
    """<body><div><a href=1>{-1}</a> <a href=2>{-1}</a> <a href=3>{-2}</a></div><div>{+6}</div><div>{+40}</div><div>{+15}</div><div>{+55}</div><div>{+15}</div><div>{+35}</div><div><a href=4>{-2}</a> <a href=5>{-2}</a></div><div>{-}Copyright 2021 Example Ltd. All rights reserved.</div></body>""",
    """<body><div><ul><li><a href=/>{-}Home</a></li><li><a href=/n>{-}News</a></li><li><a href=/a>{-}About us</a></li></ul></div><div><h1>{+6}</h1><div>{+15}</div><div>{+15}</div><div>{+16}</div><div>{+14}</div></div><div>{-}Copyright 2020 Example Inc.</div></body>""",
    # a table layout
    """<body><table><tr><td colspan=2><b>{-3}</b></td></tr><tr><td><a href=1>{-1}</a><br><a href=2>{-2}</a><br><a href=3>{-1}</a></td><td><h2>{+5}</h2><p>{+60}</p><p>{+45}</p><p>{+12}</p><p>{+70}</p></td></tr><tr><td colspan=2>{-}Copyright 1999 by the webmaster</td></tr></table></body>""",
    """<body><table width=100%><tr><td><font>{-2}</font></td></tr></table><table><tr><td>{+70}</td></tr><tr><td>{+45}</td></tr><tr><td>{+60}</td></tr></table><table><tr><td><a href=1>{-1}</a> | <a href=2>{-1}</a> | <a href=3>{-1}</a></td></tr></table></body>""",
    # a form that wraps the whole page
    """<body><form id="aspnetForm" method=post><div class="top"><a href=1>{-1}</a><a href=2>{-1}</a></div><div class="page"><h1>{+5}</h1><p>{+50}</p><p>{+40}</p><p>{+8}</p><div class="login-box"><label>{-}User name</label><label>{-}Password</label><button>{-}Log in</button></div></div><div class="bottom"><p>{-}Terms of use</p><p>{-9}</p></div></form></body>""",
    """<body><form id="f"><article><h1>{+4}</h1><p>{+30}</p><p>{+25}</p></article><div class="sidebar"><p>{-16}</p></div></form></body>""",
    # names of furniture on what holds the text
    """<body class="has-sidebar"><div class="content-with-sidebar"><div class="left"><h1>{+8}</h1><p>{+45}</p><p>{+60}</p><p>{+6}</p></div><div class="sidebar"><h4>{-}Newsletter</h4><p>{-12}</p><p><a href=1>{-5}</a></p></div></div><div class="footer">{-11}</div></body>""",
    """<body><div id="layout-sidebar-right"><div class="col"><p>{+50}</p><p>{+40}</p><p>{+9}</p></div><div class="col side"><ul><li><a href=1>{-4}</a></li><li><a href=2>{-4}</a></li></ul></div></div></body>""",
    """<body><div class="page footer-visible"><div class="header">{-4}</div><h1>{+5}</h1><p>{+35}</p><p>{+35}</p><p>{+4}</p></div></body>""",
    """<body><article class="share-price-story"><h1>{+6}</h1><p>{+45}</p><p>{+30}</p></article><section class="related"><article><h3><a href=1>{-6}</a></h3><p>{-15}</p></article><article><h3><a href=2>{-6}</a></h3><p>{-14}</p></article></section></body>""",
    """<body><main class="tag-search"><h1>{+4}</h1><p>{+40}</p><p>{+22}</p><p>{+3}</p></main><footer>{-8}</footer></body>""",
    """<body><div class="popup-enabled comment-open"><div class="story"><h2>{+7}</h2><p>{+50}</p><p>{+55}</p></div><div class="cookie-consent"><p>{-}We use cookies to improve this site.</p><p>{-16}</p><button>{-}Accept</button></div></div></body>""",
    # notices, adverts and boxes inside an article
    """<body><div class="cookie-banner"><p>{-24}</p><button>{-1}</button></div><article><h1>{+8}</h1><p class="byline">{+4}</p><p>{+60}</p><div class="advert"><p>{-15}</p></div><p>{+48}</p><div class="newsletter-signup"><h4>{-}Subscribe to our newsletter</h4><p>{-14}</p><form><button>{-}Sign up</button></form></div><p>{+52}</p><div class="social-share"><a href=f>{-1}</a><a href=t>{-1}</a></div></article></body>""",
    """<body><article><h1>{+5}</h1><p>{+40}</p><p>{-}Advertisement</p><p>{+44}</p><p>{-}Sponsored: buy now and save with our special offer</p><p>{+35}</p><p>{-}Subscribe to our newsletter for more</p><p>{-}Share this article</p></article></body>""",
    """<body><main><p>{-}Advertisement</p><h1>{+6}</h1><p>{+38}</p><p>{-}Click here to subscribe today and get a special offer</p><p>{+41}</p><p><a href=n>{-}Read more</a></p><p>{+28}</p></main></body>""",
    """<body><article><h1>{+5}</h1><p>{+}He went home after the search was over.</p><p>{+}She baked cookies and sent a reply.</p><p>{+}No comments were made on the menu.</p><p>{+30}</p></article><div><h4>{-}Most read</h4><a href=1>{-5}</a></div></body>""",
    # comments that no name marks, under a heading
    """<body><div><h1>{+5}</h1><p>{+50}</p><p>{+40}</p><p>{+30}</p></div><div><h3>{-}Comments</h3><div><b>{-1}</b><p>{-18}</p></div><div><b>{-1}</b><p>{-30}</p></div></div></body>""",
    """<body><article><h1>{+5}</h1><p>{+50}</p><p>{+40}</p></article><section><h2>{-}5 comments</h2><p>{-22}</p><p>{-35}</p><p>{-6}</p></section></body>""",
    """<body><article><h1>{+7}</h1><p>{+20}</p><p>{+25}</p></article><section class="comments"><h2>{-}Comments</h2><article class="comment"><p>{-40}</p></article><article class="comment"><p>{-60}</p></article><article class="comment"><p>{-35}</p></article></section></body>""",
    """<body><main><h1>{+7}</h1><p>{+20}</p><p>{+25}</p><div class="comment-list"><div class="comment"><p>{-50}</p></div><div class="comment"><p>{-60}</p><p>{-}Reply</p></div></div></main></body>""",
    # related stories and teasers without names
    """<body><article><h1>{+7}</h1><p>{+70}</p><p>{+50}</p></article><div><h3>{-}Related stories</h3><p><a href=1>{-8}</a></p><p>{-12} <a href=2>{-2}</a></p></div><div><h3>{-}You may also like</h3><ul><li><a href=3>{-9}</a></li><li><a href=4>{-7}</a></li></ul></div></body>""",
    """<body><article><h1>{+7}</h1><p>{+80}</p><p>{+65}</p></article><article><h2><a href=1>{-6}</a></h2><p>{-14}</p></article><article><h2><a href=2>{-5}</a></h2><p>{-16}</p></article></body>""",
    # documentation: a menu of many links, headings, code, lists, definitions
    """<body><div class="wy-nav-side"><ul><li><a href=1>{-2}</a></li><li><a href=2>{-3}</a></li><li><a href=3>{-1}</a></li><li><a href=4>{-2}</a></li></ul></div><div class="document"><h1>{+3}</h1><p>{+30}</p><h2>{+2}</h2><pre>{+20}</pre><p>{+16}</p><dl><dt>{+1}</dt><dd>{+12}</dd><dt>{+1}</dt><dd>{+9}</dd></dl><h2>{+3}</h2><ul><li>{+6}</li><li>{+4}</li></ul><table><tr><td>{+2}</td><td>{+7}</td></tr></table></div><div><a href=p>{-1}</a><a href=n>{-1}</a></div><footer><p>{-}Built with a theme. Copyright 2022.</p></footer></body>""",
    # an encyclopedia: links inside text, a table of contents
    """<body><div id="toc"><ul><li><a href=#1>{-2}</a></li><li><a href=#2>{-3}</a></li></ul></div><div id="bodyContent"><p>{+40} <a href=1>{+6}</a> {+20} <a href=2>{+5}</a></p><p>{+15} <a href=3>{+8}</a> {+12}</p><h2>{+2}</h2><p>{+50}</p><ul><li>{+4} <a href=4>{+2}</a></li></ul></div><div id="catlinks"><a href=5>{-2}</a><a href=6>{-3}</a></div></body>""",
    # a forum page and a shop, where the text is in one box
    """<body><div class="topbar"><a href=1>{-1}</a><a href=2>{-1}</a></div><div class="breadcrumbs"><a href=3>{-1}</a> &gt; <a href=4>{-2}</a></div><div class="product"><h1>{+5}</h1><div class="description"><p>{+35}</p><p>{+25}</p></div></div><div class="recommended"><h3>{-}Customers also bought</h3><div><a href=5>{-5}</a></div><div><a href=6>{-4}</a></div></div><div class="newsletter"><p>{-10}</p></div></body>""",
    # hidden parts and dialogs
    """<body><div hidden><p>{-30}</p></div><div style="display:none"><p>{-45}</p></div><dialog><p>{-20}</p></dialog><article><h1>{+5}</h1><p>{+40}</p><p>{+35}</p></article><aside><article><p>{-25}</p></article></aside></body>""",
    # long furniture
    """<body><nav>{-30}</nav><div><h1>{+4}</h1><p>{+22}</p><p>{+28}</p></div><div class="disclaimer footer"><p>{-60}</p><p>{-40}</p></div></body>""",
    """<body><header><p>{-25}</p></header><div class="text"><p>{+26}</p><p>{+24}</p></div><footer><p>{-70}</p></footer></body>""",
    # several articles, and articles whose own names say something else
    """<article><p>{+4}</p></article><nav><a href=1>{-1}</a></nav><article><p>{+3}</p></article>""",
    """<body><article><h2>{+4}</h2><p>{+30}</p></article><article><h2>{+5}</h2><p>{+24}</p></article><article><h2>{+3}</h2><p>{+36}</p></article><footer>{-9}</footer></body>""",
    """<body><main><div class="content-sidebar-wrap"><article class="post category-share"><p>{+9}</p></article><div class="sidebar"><p>{-9}</p></div></div></main></body>""",
    """<body><article class="post category-share tag-login"><p>{+9}</p><p>{+20}</p></article><div class="sidebar"><p>{-9}</p><p>{-14}</p></div></body>""",
    """<body><article><p>{+20}</p></article><article class="comment"><p>{-9}</p></article><article class="comment"><p>{-12}</p></article></body>""",
    """<body><main><article><p>{+18}</p></article><section class="comments"><article class="comment"><p>{-9}</p></article></section></main></body>""",
    """<body><main id="search-main"><p>{+9}</p></main><div class="sidebar"><p>{-9}</p></div></body>""",
    """<main><div class="related"><article><p>{-9}</p></article></div><p>{+20}</p><p>{+14}</p></main>""",
    # links that are text: whole paragraphs and lists of an article
    """<body><nav><a href=1>{-1}</a><a href=2>{-2}</a></nav><article><h1>{+5}</h1><p>{+40}</p><p><a href=3>{+9}</a></p><p>{+30}</p><ul><li><a href=4>{+6}</a> {+5}</li><li><a href=5>{+4}</a> {+8}</li></ul><p>{+20}</p></article><footer><a href=6>{-2}</a></footer></body>""",
    """<body><article><h1><a href=1>{+5}</a></h1><p>{+30}</p><p><a href=3>{+12}</a></p><p>{+25}</p><h2><a href=7>{+3}</a></h2><p>{+33}</p></article></body>""",
    # furniture that holds more words than the text
    """<body><div class="cookie-notice"><p>{-30}</p><p>{-20}</p></div><header><h2>{-3}</h2></header><article><h1>{+4}</h1><p>{+12}</p><p>{+10}</p></article><aside><p>{-30}</p></aside><footer><p>{-25}</p></footer></body>""",
    """<body><div class="sidebar"><p>{-30}</p><p>{-26}</p></div><div class="content"><h1>{+4}</h1><p>{+14}</p><p>{+12}</p></div><div class="comments"><p>{-40}</p><p>{-25}</p></div></body>""",
    """<body><div id="nav">{-12}</div><div id="article-body"><p>{+20}</p><p>{+6}</p><p>{+30}</p></div><div class="advert">{-16}</div><div id="respond"><h3>{-}Leave a reply</h3><p>{-8}</p></div></body>""",
    # a paragraph here and there is short, first, or last
    """<body><main><p>{+2}</p><p>{+30}</p><p>{+2}</p></main></body>""",
    """<body><section><h2>{+3}</h2><p>{+2}</p><p>{+40}</p><p>{+1}</p></section><section><h2>{+2}</h2><p>{+35}</p><p>{+3}</p></section><section><h2>{-}Contact us</h2><p>{-7}</p></section></body>""",
    """<body><div class="entry"><div class="entry-header"><h1>{+2}</h1></div><p>{+1}</p><p>{+25}</p><div class="entry-footer"><a href=1>{-1}</a> <a href=2>{-1}</a></div></div></body>""",
    """<article><div class="entry-header"><h1>{+2}</h1></div><p>{+1}</p></article>""",
    """<article><p>{+1}<p>{+2}</p></article><footer>{-4}</footer>""",
    """<body><aside><article><p>{-9}</p></article></aside><div hidden><article><p>{-9}</p></article></div></body>""",
    # names that speak of what stands beside
    """<body><div class="page"><div class="with-ads"><p>{+30}</p><p>{+25}</p></div><div class="ads"><p>{-8}</p></div></div></body>""",
    """<body><div class="wrapper top-level"><div class="story share-page"><h1>{+5}</h1><p>{+28}</p><p>{+22}</p></div><div class="share-bar"><a href=1>{-1}</a><span>{-3}</span></div></div></body>""",
    """<body><aside><article><p>{-9}</p></article></aside><article><p>{+12}</p></article></body>""",
    """<body><aside><p>{-9}</p><p>{-12}</p></aside></body>""",
    """<body><header><p>{-9}</p></header><footer><p>{-12}</p></footer></body>""",
    """<body><nav><p>{-6}</p></nav></body>""",
    """<body><div hidden><article><p>{-8}</p><p>{-12}</p></article></div><p>{+20}</p></body>""",
    """<body><article><p>{+8}</p><div hidden><p>{-8}</p></div><p style="display: none">{-5}</p><p>{+7}</p></article></body>""",
    """<body><div class="has-sidebar overflow-hidden"><p>{+6}</p></div></body>""",
    """<body><div id=content><p>{+6}</p></div></body>""",
    """<article><p>{+4}</p></article>""",
    """<article><p>{+9}</p></article>""",
    """<p>{+5}</p>""",
    """<div>{+12}</div>""",
    """<body><div class="main-column with-footer"><p>{+6}</p></div></body>""",
    """<body><div class="menu-story"><article><p>{+9}</p><p>{+5}</p></article></div><div class="menu"><p>{-9}</p></div></body>""",
    """<body><div class="share-page"><h1>{+4}</h1><p>{+9}</p></div><div><p>{+5}</p></div></body>""",
    """<body><div class="banner">{-9}</div></body>""",
    """<body><section class="promo"><p>{-12}</p></section><p>{+30}</p></body>""",
    """<main><div class="related"><article><p>{-9}</p></article></div><p>{+19}</p></main>""",
    """<body><article><h1>{+4}</h1><p>{+40}</p></article><div class="popular"><article><p>{-12}</p></article></div><div class="sidebar"><article><h4>{-4}</h4><p>{-9}</p></article></div></body>""",
    """<body><div class="recommended"><article><p>{-9}</p></article></div><article><p>{+30}</p><p>{+20}</p></article></body>""",
    # only paragraphs
    """<p>{+30}</p><p>{+4}</p><p>{+50}</p><p>{+12}</p>""",
    """<h1>{+3}</h1>{+40}<p>{+35}</p><hr>{+25}""",
    """<article><p>{+1}</p></article>""",
    """<body><div id=main><p>{+8}</p></div></body>""",
    """<article><p>{+3}</p><nav><a href=1>{-1}</a></nav></article>""",
    """<nav><a href=1>{-1}</a></nav>""",
    """<body><div class="page-header"><p>{-8}</p></div></body>""",
    """<body><div id=sidebar><p>{-9}</p></div></body>""",
    """<body><div role="navigation"><p>{-7}</p></div></body>""",
    """<body><div hidden><p>{-10}</p></div></body>""",
    """<body><div class="x ad-slot"><p>{-11}</p></div><div class="comment-list"><p>{-9}</p></div></body>""",
    """<body><div class="story-text"><p>{+9}</p></div><div class="overflow"><p>{+12}</p></div></body>""",
)

#: Lengths at which every page is read.
SCALES = (0.5, 1.0, 2.5)
