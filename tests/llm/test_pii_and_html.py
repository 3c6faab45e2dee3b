import hashlib
import re

from topiloom.llm import html_text as ht
from topiloom.llm import pii

from .support import BASE, LONG, ODD, empty_docs, odd_docs, table

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (2 if i % 2 else 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def plain(text):
    counts, spans = [], []
    for kind, pattern in PLAIN.items():
        n = 0
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else True,
                  "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                n += 1
                spans.append(f"{kind}:{m.start()}:{m.end()}")
        counts.append(n)
    return (*counts, ",".join(spans))


TRICKY = [
    "a@b.c_d@e.f g@h", "x@y.z@w.v", "é@b.c a.b+c%d@e-f.g.h.", "@a.b c@d", "a@b.c@d.e", "1.2.3.4.5.6.7.8", "256.1.1.1 1.2.3.4", "1.2.3.0000000000000255 x 1.2.3.99999999999999999999999",
    "4111 1111 1111 1111 4111-1111-1111-1111", "4111  1111 1111 1111", "4111111111111111 4111111111111111", "5 4 1", "+1 (314) 555-6532", "+1+2 345 678 901 2", "+12345678", "++1 234 567 890",
    "🙂🙂 a@b.c 🙂 +49 30 1234567 é 10.0.0.1", "1.2.3", "a@b", "0" * 13, "0 " * 16, "9" * 40, "a@b.c," * 700, "1" * 30_000, "a" * 30_000, "1 " * 9_000, "+1" + " " * 5000, "a@b" + ".c" * 9000,
]


def test_base_spans_like_brute_force(spark):
    rows = [*ODD, *((100 + i, t) for i, t in enumerate(TRICKY))]
    got = pii.spans(odd_docs(spark, rows)).collect()
    have = sorted(((r["doc_id"], *(r[f"n_{k}"] for k in pii.KINDS), r["base"]) for r in got), key=repr)
    assert have == sorted(((d, *plain(t)) for d, t in rows), key=repr)
    assert pii.spans(empty_docs(spark)).count() == 0


def test_words_that_give_an_entity_away(spark):
    rows = [(i, f"common words here again and then {w} writes a{i % 2}@x.org to all of us again") for i, w in enumerate(["zorblat", "quixel"] * 3)]
    rows += [(50 + i, "common words here again and then everyone writes to all of us again") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: [docs_text[w["s"]:w["e"]] for w in r["terms"]] for r in pii.spans(docs).collect() for docs_text in [dict(rows)[r["doc_id"]]]}
    assert all(got[i] == [["zorblat"], ["quixel"]][i % 2] for i in range(6)) and not any(got[50 + i] for i in range(60))
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(docs).collect()}
    assert clean[0] == "common words here again and then  writes [EMAIL] to all of us again" and clean[50] == rows[-1][1]
    # a general form that others share is kept
    more = spark.createDataFrame([*rows, *((200 + i, f"zorro number {'x' * i} rides") for i in range(30))], "doc_id long, text string")
    assert "zor* writes [EMAIL]" in {r["doc_id"]: r["text"] for r in pii.sanitise(more).collect()}[0]


def test_pii_plan_is_native(spark):
    docs = spark.read.parquet(f"{BASE}/documents.parquet")
    plan = pii.staged(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas|MapIn", plan)


def test_pii_query_like_brute_force(spark):
    texts = dict(table("documents")[["doc_id", "text"]].itertuples(index=False))
    rows = pii.op1_pii(spark, BASE).collect()
    assert len(rows) == len(texts)
    for r in rows:
        *counts, base = plain(texts[r["doc_id"]])
        assert counts == [r[f"n_{k}"] for k in pii.KINDS] and r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        assert r["spans"].startswith(base) and all(s.startswith("term:") for s in r["spans"][len(base):].split(",") if s)


def text(html, noise=frozenset()):
    return ht.Page(html).text(noise)


def test_markup_that_is_never_main_text():
    assert text("<body><nav>menu</nav><header>top</header><div class='ad'>buy</div><article><h1>T&amp;1</h1><p>a  b\n c<b>d</b><br>e<p>f<script>x</script></article>"
                "<section id=comments>no</section><footer>&copy;</footer>") == "T&1 a b cd e f"
    assert text("<div class='side-bar sidebar'>x</div><p>one</p><form>f</form><div>two<!-- c --> three</div><style>p{}</style>") == "one two three"
    assert text("<article><p>one<aside>no</aside><div class='post-comments'>no</div><p hidden>no</p><header><h1>kept</h1></header>") == "one kept"
    assert text("<title>t</title><p>a<td>b</table></div></p>c &lt;x&gt; 1 < 2") == "a b c <x> 1 < 2"
    for nothing in ("", "   ", "<p></p>", "<script>only", "<!-- open", "<nav>x"):
        assert text(nothing) == ""
    assert text("plain text only") == "plain text only" and text("<" * 5000 + "a") and text("<div>" * 4000 + "deep") == "deep"


def page(i, host, body, extra=""):
    return (i, f"https://{host}/p/{i}", f"<html><body><div class='box'>{extra}</div><div class='story'><p>{body}</p></div></body></html>")


def test_style_tree_drops_what_a_host_repeats(spark):
    rows = [page(i, "a.org", f"story number {i} of its own", "Read more on our site") for i in range(12)]
    rows += [page(20 + i, "b.org", f"tale {i}", f"different box {i}") for i in range(12)]
    rows += [page(40, "c.org", "alone", "box of one page")] + [page(50 + i, "d.org", "the same story", "the same box") for i in range(12)]
    got = {r["page_id"]: r["text"] for r in ht.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3] == "story number 3 of its own" and got[25] == "different box 5 tale 5" and got[40] == "box of one page alone"
    copies = [(60 + i, "https://e.org/x", page(0, "e.org", "copied", "box")[2]) for i in range(30)]
    got = {r["text"] for r in ht.extract(spark.createDataFrame(copies, "page_id long, url string, html string")).collect()}
    assert got == {"box copied"}  # copies of a page are one page


def dropped(pages):
    """Texts of pages of one host without the contents that all of them have."""
    keys = [{c for _, _, c, _ in ht.Page(p).nodes()} for p in pages]
    noise = frozenset(set.intersection(*keys))
    return [text(p, noise) for p in pages]


def test_nodes_below_long_and_deep_paths():
    long = "".join(f"<div class='wrapper-number-{'x' * 90}-{c}'>" for c in "abcdefgh")
    paths = [p for _, p, _, _ in ht.Page(long + "<div class='box'>again</div><div class='story'>one</div>").nodes()]
    assert len(set(paths)) == len(paths) == 10
    assert dropped([f"{long}<div class='box'>read more</div><div class='story'><p>tale {i}</p></div>" for i in range(3)]) == [f"tale {i}" for i in range(3)]
    deep = lambda i: f"<div class='out'>{'<div>' * 200}read <b>mo</b>re&nbsp; here{'</div>' * 200}</div><div class='story'>tale {i}</div>"
    keys = [{c for e, _, c, _ in ht.Page(deep(i)).nodes() if e == 1} for i in range(2)]
    assert keys[0] and keys[0] == keys[1] and text(deep(0), frozenset(keys[0])) == "tale 0"
    # the same words in other places of the mark-up, and other words in the same place
    a, b, c = ([k for e, _, k, _ in ht.Page(f"<div>{x}</div> tail").nodes() if e == 1] for x in ("one <b>t</b>wo", " one  two<br>", "one t wo"))
    assert a == b != c


def test_html_odd_cases(spark):
    rows = [(1, None, None), (2, "", ""), (3, "no url", "<p>x"), (3, "no url", "<p>x"), (None, "http://u:p@H.org:80/", "<main>y</main>"), (4, "http://h.org", "<p>" + "z " * 200_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'q' AS text", "'q' AS host", "'q' AS noise", "'q' AS key", "'q' AS path")
    got = sorted(((r["page_id"], r["text"], r["n_chars"]) for r in ht.extract(df).collect()), key=repr)
    assert got == sorted([(1, "", 0), (2, "", 0), (3, "x", 1), (3, "x", 1), (None, "y", 1), (4, ("z " * 200_000).strip(), 399_999)], key=repr)
    assert ht.extract(df.where("false")).count() == 0 and len(LONG) > 200_000


def test_html_query_like_a_plain_reading(spark):
    import html

    pages = dict(table("pages")[["page_id", "html"]].itertuples(index=False))
    for r in ht.op4_html_text(spark, BASE).collect():
        m = re.search(r"(?s)<article>(.*?)(?:</article>|$)", pages[r["page_id"]])
        want = " ".join(html.unescape(re.sub(r"<[^>]+>", "", re.sub(r"</?(?:p|h1|br)>", " ", m[1]))).split())
        assert r["text"] == want and r["n_chars"] == len(want)


def test_row_keys_tell_null_ids_apart(spark):
    from pyspark.sql import functions as F

    from topiloom.llm.tables import row_key

    rows = [(None, "5|text"), (5, "text"), (None, None), (None, ""), (None, "-"), (5, None), (51, "2"), (5, "12"), (512, ""), (512, None)]
    keys = spark.createDataFrame(rows, "doc_id long, text string").select(row_key(F.col("doc_id"), F.col("text")).alias("k")).collect()
    assert len({r["k"] for r in keys}) == len(rows)


def test_near_copies_of_a_story_keep_it(spark):
    """A story on many pages of a host stays; what is repeated beside it goes."""
    def page(i, story):
        return (i, f"http://h.org/{i}", f"<body><div class='box'>Read more of our offers today</div><div class='story'><p>{story}</p></div><div class='mark'>Token {i}</div></body>")

    story = "The river rose in the night and the bridge was closed until the water fell again. " * 3
    rows = [page(i, story) for i in range(6)] + [page(i, f"Story number {i} tells of {i * 7} other things that nobody has told before, at some length. " * 3) for i in range(6, 15)]
    got = {r["page_id"]: r["text"] for r in ht.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(15):
        assert f"Token {i}" in got[i] and "offers" not in got[i]
        assert ("The river rose" in got[i]) == (i < 6) and (f"Story number {i}" in got[i]) == (i >= 6)


def test_class_names_that_tell_no_role():
    for name in ("related-work", "search-page", "alert-letter"):
        assert ht.Page(f"<div class='{name}'>What it says</div>").text() == "What it says"
    for name in ("cookie-bar", "ad", "sidebar-left", "social share", "site-footer"):
        assert ht.Page(f"<p>Body</p><div class='{name}'>Other</div>").text() == "Body"
