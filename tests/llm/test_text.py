"""Operators 3, 4, 5 and 10."""

import collections
import math
import random
import re
import time
import zlib
from collections import Counter

from skywatch.llm import html_text, language, ppm, warc

PAGE = """<!doctype html><html><head><title>Title</title><style>p{}</style></head><body class="page"><header><h1>Site</h1></header>
<nav><ul><li><a href="/a">A</a></li></ul></nav><div class="ad">Buy, now, please, today, and save, a lot, of money.</div>
<div id="sidebar"><p>Side, side, side, a long text here that goes on and on, with commas, many, commas.</p></div>
<div class="content-with-sidebar"><div class="post-body"><h2>Head &amp; more</h2>Loose text, first.<p>Para one, long enough, to count
&eacute;tude&nbsp;x <a href=x>link</a> y<p>Para two<br>second line, again a few commas, and so on<ul><li>one<li>two</ul><table><tr><td>c1<td>c2</table></div>
<div class="cookie-notice">We use cookies.</div><div class="comments"><p>I, too, like this, very, very, much, indeed, oh yes, a long comment.</p></div></div>
<form><p>Name</p></form><!-- <p>gone</p> --><footer>f</footer><script>if(a<b){"</p>"}</script></body></html>"""


def test_main_text_of_a_page():
    assert html_text.main_text(PAGE) == "\n".join([
        "Head & more", "Loose text, first.", "Para one, long enough, to count étude x link y", "Para two second line, again a few commas, and so on", "one", "two", "c1", "c2"])


def test_main_text_edge_cases():
    for page, text in [(None, ""), ("", ""), ("<", "<"), ("&amp;", "&"), ("<!-- open", ""), ("<div>" * 20_000 + "deep", "deep"), ("<p>a</p>" * 3, "a\na\na"),
                       ("</div></p>x", "x"), ("<article><p>Be.</p></article><footer>f</footer>", "Be."), ("<nav>only</nav>", "")]:
        assert html_text.main_text(page) == text


def test_main_text_is_linear_in_malformed_pages():
    """A megabyte each; quadratic steps would take hours."""
    begin = time.process_time()
    for page in ('<a b="' * 160_000, "<i></p>" * 140_000, "<center>x" * 100_000, "<i>" * 50_000 + "<div>x</div>" * 80_000, "<h1>" * 200_000,
                 "<p><li>x" * 100_000, "<!--" * 250_000, "<" * 1_000_000, "<a b='x>" * 120_000 + ">", "<article><header>" * 50_000 + "x"):
        html_text.main_text(page)
    assert time.process_time() - begin < 120
    assert html_text.main_text("<p>a</p>" + '<a b="' * 3 + "c>d</a><p>e</p>") == "a\nd\ne"


def test_main_text_keeps_an_articles_own_header():
    text = "Some text, long enough to count, with commas, and more of it, as articles have."
    page = f"<header><a href=/>Site</a> <a href=/n>News</a></header><article><header><h1>Title</h1><p>By A. Author</p></header><p>{text}</p></article>"
    assert html_text.main_text(page) == f"Title\nBy A. Author\n{text}"
    assert html_text.main_text(f"<article><header><a href=/>One</a> <a href=/b>Two</a></header><p>{text}</p></article>") == text


def test_main_text_keeps_what_stands_beside_the_best_container():
    def words(page):
        return html_text.main_text(page).split("\n")

    for n in (1, 5, 40):  # the same page, however long
        paras = ["One, two, three, and so on, a sentence of an ordinary length, with commas, as they come."] * n
        body = "".join(f"<p>{x}</p>" for x in paras)
        assert words(f"<article><h1>T</h1><div class=content>{body}</div><ul><li>a<li>b</ul></article>") == ["T", *paras, "a", "b"]
        assert words(f"<main><h1>T</h1><div><div>{body}</div><pre>x</pre></div><table><tr><td>c</table></main>") == ["T", *paras, "x", "c"]
        assert words(f"<div><section>{body}</section><section><h2>Conclusion</h2><p>short</p></section></div>") == [*paras, "Conclusion", "short"]
        blocks = "<h2>H</h2><ul><li>a</ul><ol><li>b</ol><table><tr><td>c</table><pre>d</pre><blockquote>e</blockquote><figure><figcaption>f</figure>"
        links = "<ul><li><a href=/x>Menu</a><li><a href=/y>Entry</a></ul><p><a href=/z>More</a>"
        assert words(f"<body>{links}<h1>T</h1><div>loose<div>{body}</div>{blocks}</div>{links}</body>") == ["T", "loose", *paras, "H", *"abcdef"]


def test_main_text_keeps_what_a_title_names():
    para = "One, two, three, and so on, a sentence of an ordinary length, with commas, as they come."
    parts = ["<h2 id=related-work>a</h2>", "<section id=legal-framework><p>b</section>", "<div class=search-results><p>c</div>", "<h2 id=social-life>d</h2>", "<p class=form-of-government>e</p>",
             "<h2 id=discussion class=page-header>f</h2>", "<section id=pagination><p>g</section>", "<p id=copyright>h</p>", "<div id=recommendations><p>i</div>"]
    beside = ["<div class=ad>x</div>", "<div class='cookie-notice'>x</div>", "<ul class=share-buttons><li>x</ul>", "<div id=c class='comments-area'><p>x</div>", "<p class=notice>x</p>", "<h3 hidden>x</h3>"]
    for around in ("<article>%s</article>", "<main><div>%s</div></main>", "<body><div>%s</div></body>"):
        assert html_text.main_text(around % (f"<p>{para}</p>" + "".join(parts + beside))) == "\n".join([para, *"abcdefghi"])
    for name in ("id=sidebar", "id=comments", "class=legal", "class=related-posts", "id=site-footer", "class=post-comments2"):
        assert html_text.main_text(f"<body><div><p>{para}</p></div><div {name}><p>x</div></body>") == para


def test_main_text_of_a_page_in_a_form():
    para = "One, two, three, and so on, a sentence of an ordinary length, with commas, as they come."
    small = "<form><label>User</label><p>Join us.</p><select><option>x</select></form>"
    page = f"<header><h1>Site</h1></header><div><h1>T</h1><p>{para}</p><fieldset><legend>L</legend><label>Search <input name=q></label>Hint</fieldset><p>{para}</p></div>{small}"
    for around in ("%s", "<form id=form1 role=form class=form>%s</form>", "<fieldset>%s</fieldset>", "<form><header>%s</header></form>"):
        got = html_text.main_text("<body>" + around % page + "<footer>f</footer></body>")
        assert got == f"T\n{para}\n{para}"
    assert html_text.main_text(f"<main><p>Be.</main><form><p>{para}</form>") == "Be."
    assert html_text.main_text(f"<form><main><p>Be.</main><nav>n</nav></form><header><p>{para}</header>") == "Be."
    assert html_text.main_text(f"<form class=search-form><input></form><p>{para}</p><label>kept</label>") == f"{para}\nkept"


def test_extract_keeps_other_columns(spark):
    df = spark.createDataFrame([(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (None, None, None, None)], "page_id long, url string, html string, text string")
    out = html_text.extract(df).collect()
    assert [len(r.text) > 0 for r in out] == [True, True, False] and html_text.extract(df).columns == ["page_id", "url", "text"]
    assert html_text.extract(df.limit(0)).count() == 0


def test_archives_round_trip(spark, tmp_path):
    big = "<p>" + "ä" * 100 + "\r\n\r\nWARC/1.1\r\n</p>"
    rows = [(3, "http://www.b.org/x?q=1#f", big), (1, "http://b.org/x", big), (2, "https://a.org", "small"), (4, "http://a.org/", "small"), (5, None, None), (6, "bad url\r\nX: y", big + "2"),
            (None, "http://c.org", big), (7, "http://c.org/é", ""), (3, "http://www.b.org/x?q=1#f", big)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, offset int")
    index = warc.archive_index(df, str(tmp_path / "w"), records_per_archive=2).collect()
    assert all(r.payload_ok for r in index) and len(index) == len(rows) and len({r.archive for r in index}) > 1
    assert [warc._key(r) for r in index] == sorted(warc._key(r) for r in index)
    kinds = Counter((r.page_id, r.record_type, r.refers_to) for r in index)
    assert kinds == Counter([(1, "response", None), (3, "revisit", 1), (3, "revisit", 1), (None, "revisit", 1), (2, "response", None), (4, "response", None), (5, "response", None),
                             (6, "response", None), (7, "response", None)])
    for r in index:
        want = next((h or "").encode() for i, _, h in rows if i == r.page_id)
        assert r.payload_bytes == len(want)


def test_archives_of_nothing(spark, tmp_path):
    assert warc.archive_index(spark.createDataFrame([], "page_id long, url string, html string"), str(tmp_path / "w")).count() == 0


def test_loser_tree_merges():
    r = random.Random(4)
    for k in (0, 1, 2, 3, 7, 16):
        runs = [sorted(r.randrange(50) for _ in range(r.randrange(20))) for _ in range(k)]
        assert list(warc.LoserTree([iter(x) for x in runs], lambda x: x)) == sorted(x for run in runs for x in run)


def test_surt():
    assert warc.surt("http://WWW.Example.org:80/a?b#c") == "org,example)/a?b"
    assert warc.surt("http://example.org:8080") == "org,example:8080)/"


def test_language_held_out_accuracy(spark, sf_small):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    out = language.op5_language(spark, "/root/testdata/sf0.01").join(docs, "doc_id").where("held_out").collect()
    assert len(out) > 200 and sum(r.lang == r.lang_pred for r in out) >= 0.98 * len(out)
    assert all(0 <= r.score <= 1 for r in out)


def test_language_edge_cases(spark):
    train = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate([("the house and the garden of the man", "en"), ("das haus und der garten von dem mann", "de"),
                                                                             ("la maison et le jardin des hommes", "fr"), ("xyz", None), (None, "en")] * 6)], "doc_id long, text string, lang string")
    model = language.fit(train)
    assert model.languages == ["de", "en", "fr"] and set(model.members) == {"germanic", "romance"}
    df = spark.createDataFrame([(1, None, "a"), (2, "", "a"), (3, "123 !?", "a"), (4, "the man and the house", "a"), (4, "the man and the house", "a"), (None, "… … 7", "a"), (5, "der mann " * 200_000, "a")],
                               "doc_id long, text string, score string")
    got = language.identify(df, model)
    assert got.columns == ["doc_id", "text", "lang_pred", "score"]
    rows = [(r.doc_id, r.lang_pred) for r in got.collect()]
    assert Counter(rows) == Counter([(1, "und"), (2, "und"), (3, "und"), (4, "en"), (4, "en"), (None, "und"), (5, "de")])
    nothing = language.fit(train.limit(0))
    assert [r.lang_pred for r in language.identify(df, nothing).collect()] == ["und"] * 7
    one = language.fit(train.where("lang = 'en'"))
    assert {r.lang_pred for r in language.identify(df, one).collect()} == {"und", "en"}


def brute_ppm(rows, order):
    counts = [collections.defaultdict(Counter) for _ in range(order + 1)]
    low = lambda t: bytes(b + 32 if 65 <= b <= 90 else b for b in (t or "").encode())
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    word = re.compile(rb"[^\x20\x09-\x0D]+")
    words, texts = Counter(), 0
    for i, t in rows:
        if not held(i):
            texts += 1
            words.update(word.findall(low(t)))
            b = bytes([0xFE] * order) + low(t) + b"\xff"
            for p in range(order, len(b)):
                for k in range(order + 1):
                    counts[k][b[p - k:p]][b[p]] += 1
    n, v = sum(words.values()) + texts, len(words) + (texts > 0)
    out = []
    for i, t in rows:
        b, total = bytes([0xFE] * order) + low(t) + b"\xff", 0.0
        for p in range(order, len(b)):
            out_of = set()
            for k in range(order, -1, -1):
                left = {x: c for x, c in counts[k].get(b[p - k:p], {}).items() if x not in out_of}
                if not left:
                    continue
                size = sum(left.values()) + len(left)
                if b[p] in left:
                    total += math.log10(left[b[p]] / size)
                    break
                total += math.log10(len(left) / size)
                out_of |= set(left)
            else:
                total -= math.log10(255 - len(out_of))
        own = word.findall(low(t))
        base = sum(math.log10((words[x] + 0.5) / (n + 0.5 * (v + 1))) for x in own) + math.log10((texts + 0.5) / (n + 0.5 * (v + 1)))
        out.append((i, held(i), len(own) + 1, sum(words[x] > 0 for x in own) + (texts > 0), n, round(base, 4), round(total, 3)))
    return out


def scored(df, **options):
    return Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4), round(r.score, 3)) for r in ppm.score(df, **options).collect())


def test_ppm_against_brute_force(spark):
    r = random.Random(10)
    rows = [(i, " ".join(r.choice(["the", "The", "cat", "sat", "über", "mat."]) for _ in range(r.randrange(30)))) for i in range(60)]
    rows += [(None, None), (100, ""), (101, " \t\n"), (102, "the the\x00the"), (3, rows[3][1]), (103, "z" * 3000)]
    df = spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, v int")
    assert scored(df, pack_bytes=400) == Counter(brute_ppm(rows, ppm.ORDER))
    assert scored(df, order=3) == Counter(brute_ppm(rows, 3))


def test_ppm_without_training_texts(spark):
    held = next(i for i in range(100) if ppm.is_held_out(i))
    rows = [(held, "ab")]
    assert scored(spark.createDataFrame(rows, "doc_id long, text string")) == Counter(brute_ppm(rows, ppm.ORDER))
    assert ppm.score(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_ppm_bytes_that_are_its_marks(spark):
    def of(odd):
        rows = [(i, b"the cat " + odd * (i % 3) + b" sat") for i in range(40)]
        return ppm.score(spark.createDataFrame(rows, "doc_id long, raw binary").selectExpr("doc_id", "CAST(raw AS STRING) AS text")).collect()

    marks, others = (sorted(map(tuple, of(x))) for x in (b"\xfe\xff", b"\xfd\xfd"))
    assert marks == others and len(marks) == 40
