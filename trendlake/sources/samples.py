"""A small list page of every site with the posts in it, for tests and for the query extract_sites."""

# site: page, and (title, url, upvotes, comments, views, image) of its posts.
PAGES = {
    "clien": (
        '<div class="list_item symph_row"><a class="list_subject" href="/p/1"><span class="list_subject"><span class="subject_fixed"> Title <b>one</b></span></span></a><img src="t.jpg"><i class="list_recommend">1,2</i><i class="list_reply"><b class="rSymph">3</b></i><i class="list_hit">x</i></div><div class="list_item symph_row"><p>no title</p></div>',
        [("Titleone", "https://www.clien.net/p/1", 12, 3, 0, "t.jpg")],
    ),
    "ruliweb": (
        '<table><tr class="table_body best"><td><a class="deco" href="https://bbs.ruliweb.com/9">T</a><span class="num_reply">(<span class="num">4</span>)</span></td><td class="recomd">5</td><td class="hit">1,000</td></tr><tr class="table_body"><td><a class="deco" href="/no">no</a></td></tr></table>',
        [("T", "https://bbs.ruliweb.com/9", 5, 4, 1000, None)],
    ),
    "ppomppu": (
        '<table><tr class="baseList"><td><a class="baseList-thumb"><img src="//i.example/a.jpg"></a><a class="baseList-title" href="/zb?no=1">Deal</a><span class="list_comment2">7</span></td><td class="board_date">10:00</td><td class="board_date">12 - 3</td><td class="board_date">99</td></tr><tr class="bbs_new"><td class="baseList-title"><a href="read.php">Other</a></td><td class="board_date">5</td></tr></table>',
        [("Deal", "https://www.ppomppu.co.kr/zb?no=1", 12, 7, 99, "https://i.example/a.jpg"), ("Other", "https://www.ppomppu.co.krread.php", 0, 0, 5, None)],
    ),
    "mlbpark": (
        '<p><a href="/mp/b.php?b=x&id=1">abcd</a></p><p><a href="/mp/b.php?b=x&id=2">abcde</a><i class="likeNum">2</i><i class="reply">3</i><i class="hit">4</i></p><p><a href="/mp/b.php?b=x&id=3">abcde</a></p>',
        [("abcde", "https://mlbpark.donga.com/mp/b.php?b=x&id=2", 2, 3, 4, None)],
    ),
    "bobaedream": (
        '<table><tr><td><a class="bsubject" href="/v?1" title="Long title">Lon..</a></td><td class="recomm">8</td><td class="replyNum">2</td><td class="hit">6</td></tr><tr><td><a class="bsubject" href="/v?2"> </a></td></tr></table><a class="bsubject" href="/v?3">out</a>',
        [("Long title", "https://www.bobaedream.co.kr/v?1", 8, 2, 6, None), ("out", "https://www.bobaedream.co.kr/v?3", 0, 0, 0, None)],
    ),
    "inven": (
        '<li><a href="/board/lol/1/22">3Some news[15]</a></li><a href="/board/lol/list">Not a post</a><a href="https://www.inven.co.kr/board/a/2/3">12abc</a>',
        [("Some news[15]", "https://www.inven.co.kr/board/lol/1/22", 0, 15, 0, None)],
    ),
    "dcinside": (
        '<table><tr class="ub-content"><td class="gall_tit"><a class="reply_num" href="/r">[1,2]</a><a href="/b?no=1">Post</a></td><td class="gall_count">30</td><td class="gall_recommend">4</td></tr></table>',
        [("Post", "https://gall.dcinside.com/b?no=1", 4, 12, 30, None)],
    ),
    "humoruniv": (
        '<table><tr><td><img class="thumb" src="//t.example/1.jpg"></td><td><a href="read.html?n=1">Funny story [7]<span>답글추천 +5</span></a></td></tr></table><ul><li><img class="thumb" src=""><a href="read.html?n=2">abc [1]</a></li><li><img class="thumb" src=""><a href="read.html?n=3">abcd</a></li></ul>',
        [("Funny story", "https://web.humoruniv.com/board/humor/read.html?n=1", 5, 7, 0, "https://t.example/1.jpg"), ("abcd", "https://web.humoruniv.com/board/humor/read.html?n=3", 0, 0, 0, None)],
    ),
    "82cook": (
        '<div class="leftbox Best"><ul class="most"><li><a href="/entiz/read.php?n=1" title="Full title">Fu</a></li><li><a href="read.php?n=2">ab</a></li></ul></div><a href="read.php?n=3">outside</a>',
        [("Full title", "https://www.82cook.com/entiz/read.php?n=1", 0, 0, 0, None)],
    ),
    "theqoo": (
        '<table><tr><td><a class="replyNum" href="/hot/1#c">9</a><a href="/hot/1">ab</a></td></tr><tr><td><a href="/hot/1">late title</a></td></tr><tr><td><a href="/hot/category">cat title</a></td></tr><tr><td><a href="/hot/2">fine title</a><a class="replyNum">1,9</a></td><td>321</td></tr></table>',
        [("fine title", "https://theqoo.net/hot/2", 0, 19, 321, "og2")],
    ),
    "slrclub": (
        '<table><tr><td><a href="/bbs/vx2.php?no=1">ab [3]</a></td><td>5</td></tr><tr><td><a href="/bbs/vx2.php?no=1">long enough</a></td><td>6</td></tr><tr><td><a href="/bbs/vx2.php?no=2">photo post [12] [3]</a></td><td>77</td></tr></table>',
        [("photo post", "https://www.slrclub.com/bbs/vx2.php?no=2", 0, 12, 77, "https://media.slrclub.com/2.jpg")],
    ),
    "todayhumor": (
        '<table><tr><td>1</td><td class="subject"><a href="/board/view.php?no=1">joke one</a></td><td>100</td><td>20</td></tr><tr><td class="subject"><a href="/board/view.php?no=2">joke two</a></td></tr></table>',
        [("joke one", "https://www.todayhumor.co.kr/board/view.php?no=1", 20, 0, 100, None), ("joke two", "https://www.todayhumor.co.kr/board/view.php?no=2", 0, 0, 0, None)],
    ),
    "etoland": (
        '<a href="../bbs/board.php?wr_id=1">x</a><a href="/bbs/board.php?wr_id=1">same place (4)</a><a href="board.php?wr_id=2">news item (31) </a>',
        [("news item", "https://www.etoland.co.kr/bbs/board.php?wr_id=2", 0, 31, 0, None)],
    ),
    "instiz": (
        '<table><tr id="detour"><td class="listsubject"><a href="/pt/1?page=2"><span class="texthead_notice">hello<span class="cmt3" title="n 9">9</span></span></a></td><td class="listno" width="45">1,500</td><td class="listno" width="25">8</td></tr><tr id="detour"><td class="listsubject"><a href="/pt/1?page=3">hello again</a></td></tr><tr id="detour"><td class="listsubject"><a href="/pt/2">plain</a><span class="cmt3" title="n 41">x</span></td></tr></table>',
        [("hello", "https://www.instiz.net/pt/1?page=2", 8, 0, 1500, None), ("plain", "https://www.instiz.net/pt/2", 0, 41, 0, None)],
    ),
    "ygosu": (
        '<table><tr><td class="tit"><a href="/board/best_article/1/?x"><span class="category">cat</span>title<span class="reply_cnt">(5)</span></a></td></tr><tr><td class="tit"><a href="/board/best_article/2/">other</a><span class="reply_cnt">(6)</span></td></tr><tr><td>none</td></tr></table>',
        [("title", "https://ygosu.com/board/best_article/1/?x", 0, 0, 0, None), ("other", "https://ygosu.com/board/best_article/2/", 0, 6, 0, None)],
    ),
    "natepann": (
        '<ol id="talkerChoiceArea1"><li><a href="/talk/3">third one</a></li></ol><ol id="talkerChoiceArea0"><li><a href="/talk/1" title=" ab ">x</a></li><li><a href="/talk/1" title=" first ">x</a><span class="count"><i>1,1</i></span></li><li><a href="/other/2">other</a></li></ol>',
        [("first", "https://pann.nate.com/talk/1", 11, 0, 0, None), ("third one", "https://pann.nate.com/talk/3", 0, 0, 0, "og3")],
    ),
    "fmkorea": (
        '<ul><li class="li"><h3 class="title"><a href="/i.php?document_srl=5">Best post [8]</a></h3><img src="i.jpg"><b class="recom">3</b><b class="replyNum">8</b><b class="hit">2</b></li><li class="li"><div class="title"><a href="/6">Best post</a></div></li><li class="li"><div class="title"><a href="/7">Second</a></div></li></ul>',
        [("Best post", "https://www.fmkorea.com/5", 3, 8, 2, "i.jpg"), ("Second", "https://www.fmkorea.com/7", 0, 0, 0, "og7")],
    ),
    "ddanzi": (
        '<table><tr><td><a href="https://www.ddanzi.com/free/1">abcde</a></td><td class="vote">1</td><td class="reply">2</td><td class="readedCount">3</td></tr></table><p><a href="//www.ddanzi.com/free/2">fghij</a><b class="good">4</b></p>',
        [("abcde", "https://www.ddanzi.com/free/1", 1, 2, 3, None), ("fghij", "//www.ddanzi.com/free/2", 4, 0, 0, None)],
    ),
}
OG = '<meta property="og:image" content="{}">'
DETAILS = [
    ("https://theqoo.net/hot/2", OG.format("og2")),
    ("https://www.slrclub.com/bbs/vx2.php?no=2", '<img src="//media.slrclub.com/1.png"><img src="//media.slrclub.com/2.jpg">'),
    ("https://www.todayhumor.co.kr/board/view.php?no=1", OG.format("test.png")),
    ("https://www.etoland.co.kr/bbs/board.php?wr_id=2", OG.format("no_image.gif")),
    ("https://pann.nate.com/talk/3", OG.format("og3")),
    ("https://www.fmkorea.com/5", OG.format("og5")),
    ("https://www.fmkorea.com/7", OG.format("og7")),
]
