import hashlib
import re
from collections import Counter

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tarnish.llm import chat, html_text, quality, queries, secret_scan

from .conftest import words

SYMBOLS = re.compile(r"[#*$%&|<>]")


def base_figures(text):
    w = words(text)
    found = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {j for i in range(len(w) - 2) if found[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return len(w), sum(map(len, w)), len(SYMBOLS.findall(text or "")), len(lines) - len(set(lines)), len(covered)


def test_quality_base_figures(docs, rows, empty):
    got = quality.score(docs).collect()
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    assert sorted((r["doc_id"], *(r[n] for n in names)) for r in got) == sorted((r[0], *base_figures(r[1])) for r in rows)
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert not (r["kept"] and r["base_failed"]) and set(r["votes"]) == set(quality.RULES)
    assert quality.score(empty).count() == 0


def test_distinct_words_count_in_texts_of_any_length(spark):
    few = lambda n: " ".join("the" if k % 8 == 0 else f"word{k * k * 7919 % 199}" for k in range(n))
    texts = [few(1900), few(2001), few(5000), few(30_000), few(1900) + " " + " ".join(f"w{k}" for k in range(20_000)), few(100), "", None]
    got = quality.figures(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string"), "t").select("i", "distinct_share", quality.vote("distinct_share").alias("vote")).collect()
    blocks = lambda w: [w[a : a + 2000] for a in range(0, len(w), 2000)]
    for r in got:
        w = words(texts[r["i"]])
        assert r["distinct_share"] == (sum(len(set(b)) for b in blocks(w)) / len(w) if w else None)
    assert [r["vote"] for r in sorted(got)] == [-1, -1, -1, -1, 1, 1, 0, 0]


def test_quality_on_labels(spark):
    d = "/root/testdata/sf0.1"
    verdict = queries.op4_quality(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id")
    found = {(r["quality"], r["kept"]): r["n"] for r in verdict.where("n_words >= 50").groupBy("quality", "kept").agg(F.count("*").alias("n")).collect()}
    assert found.get((1, False), 0) <= 0.01 * found[1, True]
    assert found.get((0, True), 0) <= 0.05 * found[0, False]


def test_em_finds_the_accurate_rule():
    # Two rules that agree on a bad tenth, one that is right half the time.
    patterns = [((1, 1, 1), 450), ((1, 1, -1), 450), ((-1, -1, 1), 50), ((-1, -1, -1), 50)]
    prior, rates = quality.estimate(patterns)
    assert abs(prior - 0.9) < 0.05
    assert quality.log_odds((1, 1, -1), prior, rates) > 0 > quality.log_odds((-1, -1, 1), prior, rates)
    assert abs(quality.log_odds((0, 0, -1), prior, rates) - quality.log_odds((0, 0, 0), prior, rates)) < 0.5
    assert quality.estimate([]) == (0.5, [])


ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)


def base_spans(text):
    text = text or ""
    out = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def more_spans(text):
    kinds = {r.kind: i for i, r in enumerate((*secret_scan.BASE_RULES, *secret_scan.MORE_RULES))}
    return sorted((m.start(), kinds[r.kind], m.end(), r.kind) for r in secret_scan.MORE_RULES for m in re.finditer(r.regex, text or "", re.A))


def test_urls_take_linear_time(spark):
    import time

    text = "a.b+" * 500_000 + " " + "http://" + "u" * 2_000_000 + " " + "x://y" * 200_000
    begun = time.time()
    assert secret_scan.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()["spans"] == []
    assert time.time() - begun < 60


@pytest.mark.parametrize("many", ["eyJ", ".ey ", "eyJaaaaaaaa.", "eyJaaaaaaaa.eyJaaaaaaaa", "ghp_", "xoxb-", "sk_live_", "AIza", "-----BEGIN ", "-----BEGIN PRIVATE", "x://y:", "token", "token='", "AKIA", "0123456789abcdef"])
def test_every_rule_takes_linear_time(spark, many):
    import time

    begun = time.time()
    secret_scan.scan(spark.createDataFrame([(1, many * (400_000 // len(many)))], "doc_id long, text string")).collect()
    assert time.time() - begun < 60


def secret_texts():
    key, low = "AKIA" + "Q" * 16, "0123456789abcdef" * 2
    return [
        f"🎈 token={low} and Secret: x, secret: token: abcdefgh", f"{key}{key} {key[:-1]}", f"api_key = 'a.b-c/d' APIKEY:\"{low}", "passwd:abcdef password==abc", None, "", low[:23] + " " + low,
        "gh" + "p_" + "a1B2" * 10, "x" * 3000 + f" token: {low}", "-----BEGIN " + "RSA PRIVATE KEY-----", "ftp://user:" + "hunter2x@host", f"ſecret={low}",
        "s" * 40 + "://" + "u" * 90 + ":" + "hunter2x" * 40 + "@host", "9http://u:" + "hunter2x@host", "xox" + "b-" + "1234567890a", "sk" + "_live_" + "a1B2" * 5, "AI" + "za" + "a1B2_" * 7,
        "eyJ" + "hbGciOiJI." + "eyJ" + "zdWIiOiIx." + "dozjgNryP4",
    ]


def test_secret_spans(spark):
    texts = secret_texts()
    df = spark.createDataFrame([(i // 2, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, spans int")
    got = secret_scan.scan(df).collect()
    base = {r.kind for r in secret_scan.BASE_RULES}
    found = {r["text"]: sorted((s["start"], s["kind"], s["end"], s["name"]) for s in r["spans"]) for r in got}
    assert len(got) == len(texts)
    for t in texts:
        assert [s for s in found[t] if s[3] in base] == base_spans(t)
    more = {s[3] for spans in found.values() for s in spans} - base
    assert more == {"github", "pem", "url_password", "slack", "stripe", "google", "jwt"}
    for t in texts:
        assert [s for s in found[t] if s[3] not in base] == more_spans(t)
    assert secret_scan.scan(df.limit(0)).count() == 0


def test_trigram_queries_hold_for_matches():
    assert secret_scan.trigram_query("[0-9a-f]{24,}") is None
    assert secret_scan.trigram_query("AKIA[A-Z0-9]+") == [frozenset({"aki", "kia"})]
    assert secret_scan.trigram_query("password|to[kq]en") == [frozenset({"ssw", "wor"}), frozenset({"ken", "tok"}), frozenset({"qen", "toq"})]
    for rule in (*secret_scan.BASE_RULES, *secret_scan.MORE_RULES):
        query = secret_scan.trigram_query(rule.regex)
        for text in filter(None, secret_texts()):
            for m in re.finditer(rule.regex, text, re.A):
                assert query is None or any(all(g in m[0].lower() for g in way) for way in query)


TEXTS = st.lists(st.sampled_from([*"ab<|>\\\nn_im🎈", chat.START, chat.END, chat.NEXT]), max_size=30).map("".join)


def chats_of(spark, turns):
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    out = chat.format_chats(df)
    return {r["conv_id"]: r for r in out.select("conv_id", "formatted", chat.read_back(F.col("formatted")).alias("turns"), chat.loss_text(F.col("segments")).alias("loss")).collect()}


def test_chat_round_trip(spark):
    cases = []

    @given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "sys\ntem", "a\\n", ""]), TEXTS), min_size=1, max_size=6))
    def gather(turns):
        cases.append(turns)

    gather()
    rows = [(c, t, role, text) for c, turns in enumerate(cases) for t, (role, text) in enumerate(turns)]
    got = chats_of(spark, rows)
    for c, turns in enumerate(cases):
        assert [tuple(t) for t in got[c]["turns"]] == turns
        assert got[c]["loss"] == "".join(t for r, t in turns if r == "assistant")


def test_chat_merges_ties_and_nulls(spark):
    got = chats_of(spark, [(1, 2, "user", "c"), (1, 1, "user", "b"), (1, 1, "user", "a"), (1, 3, None, None), (None, None, "assistant", "x"), (1, 4, "assistant", None)])
    assert got[1]["formatted"] == "<|im_start|>user\na<|im_next|>b<|im_next|>c<|im_end|>\n<|im_start|>\n<|im_end|>\n<|im_start|>assistant\n<|im_end|>\n"
    assert got[None]["loss"] == "x" and got[1]["loss"] == ""
    assert chats_of(spark, [(1, 1, "user", "x")][:0]) == {}


def test_chat_query_reads_back_the_table(spark):
    d = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-1, 0, "user", queries.PLANTED_TURN), (-1, 1, "assistant", queries.PLANTED_TURN)]
    by = {}
    for c, _, role, text in sorted(rows, key=lambda r: r[:2]):
        by.setdefault(c, []).append((role, text))
    for r in queries.op5_chat(spark, d).collect():
        turns = by.pop(r["conv_id"])
        loss = "".join(t for role, t in turns if role == "assistant")
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert (r["n_turns"], r["loss_chars"], r["loss_sha256"]) == (len(turns), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert not by


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a = "<p>no</p>";</script><style>p{}</style></head><body class="has-sidebar">
<header class="site"><h2>Site name</h2></header><nav><ul><li><a href=/>Home</a><li><a href=/x>More</a></ul></nav>
<div class="cookie-notice"><p>We use cookies, and more; accept them, please, so that all of this works as it should.</p></div>
<div id=wrap><div class="story"><h1>A &lt;title&gt;</h1><p>The <b>first</b>&nbsp;paragraph, with&#32;text. It goes on,<br>and on, for a while.<p>Short.
<ul><li>Item one, said.</li><li>Item two.</li></ul><form><input><button>Send this now, please.</button></form><blockquote>Quoted words, too.</blockquote></div>
<div class="sidebar"><p>Aside text, also long. It goes on, and on, and on, for quite a while, and then some.</p></div></div>
<section id="comments"><h3>Comments</h3><p>I think, well, this is great. Very great. Really, yes. Indeed, one could say so again.</p></section>
<footer>&copy; nobody</footer></body></html>"""
ARTICLE = "A <title>\n\nThe first paragraph, with text. It goes on, and on, for a while.\n\nShort.\n\nItem one, said.\n\nItem two.\n\nQuoted words, too."


@pytest.mark.parametrize(
    ("html", "text"),
    [(PAGE, ARTICLE), ("", ""), (None, ""), ("only text &amp; no markup", "only text & no markup"), ("<p>a<p>b", "a\n\nb"), ("<nav><a>x</a></nav>", ""), ("<p>unclosed <b>bold", "unclosed bold"), ("<" * 50, "<" * 50)],
)
def test_main_text(html, text):
    assert html_text.main_text(html or "") == text


def test_extract_keeps_columns(spark):
    df = spark.createDataFrame([(1, PAGE, "c"), (1, PAGE, "c"), (None, None, None)], "page_id long, html string, main_text string")
    assert sorted(map(tuple, html_text.extract(df).collect()), key=str) == sorted([(1, ARTICLE), (1, ARTICLE), (None, "")], key=str)
    assert html_text.extract(df.limit(0)).count() == 0


def test_generated_articles_come_back_whole(spark):
    import html as entities

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    for r in pages:
        inner = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        parts = [" ".join(entities.unescape(re.sub(r"</?(b|br)>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", inner)]
        assert html_text.main_text(r["html"]) == "\n\n".join(p for p in parts if p)


LONG = "A comment, that goes on, and on; quite long, really. " * 60


@pytest.mark.parametrize("inner", [f"<p>{LONG}</p>", f"<article><p>{LONG}</p></article>", f"<form><p>{LONG}</p></form>"])
@pytest.mark.parametrize("kind", ['div class="comments"', "aside", "footer", "nav", 'div class="ad"', "div hidden"])
def test_what_is_apart_stays_out_however_long(kind, inner):
    body = "<h1>Title</h1><p>Some text, of the article. It is short.</p><p>More, though.</p>"
    text = "Title\n\nSome text, of the article. It is short.\n\nMore, though."
    for page in (f"<article>{body}</article>", f"<div class=post>{body}</div>", body):
        assert html_text.main_text(f"<html><body class='comments-open'>{page}<{kind}>{inner}</{kind.split()[0]}></body></html>") == text


@pytest.mark.parametrize("wrap", ['<form id="all">{}</form>', '<div class="has-sidebar">{}</div>', '<div class="comments-open">{}</div>'])
def test_wrappers_of_the_page_are_not_apart(wrap):
    page = wrap.format("<nav>Menu</nav><main><h1>Title</h1><p>Some text, here.</p></main><div id=comments><p>No.</p></div>")
    assert html_text.main_text(page) == "Title\n\nSome text, here."
    assert html_text.main_text(page.replace("main>", "div>")) == "Title\n\nSome text, here."


@pytest.mark.parametrize("n", [1, 300])
@pytest.mark.parametrize("outer", ["article", "main", "div"])
def test_an_article_is_whole_however_long(n, outer):
    long = "A sentence, of the body. " * n
    end = "<p><a href=/s>A linked paragraph</a></p><h2>Sources</h2><ul><li><a href=/1>One source</a></li><li><a href=/2>Two</a></li></ul>"
    page = f"<html><head><title>T</title><body><div class=x><ul><li><a href=/>Home</a><li><a href=/b>More</a></ul></div><{outer}><h1>Title</h1><p class=lead>The lead, of the text.</p><div class=body><p>{long}</p>{end}</div></{outer}>"
    assert html_text.main_text(page) == "\n\n".join(["Title", "The lead, of the text.", long.strip(), "A linked paragraph", "Sources", "One source", "Two"])


@pytest.mark.parametrize("many", ["<div>", "<div>x", "<p><div>x", "<ul><li>", "<b>", "<p><button><div>", "</p>", "<table><td><p>", "<b></div>", "<a ", "<!--", "<!-- >", "</a ", "<![CDATA[", "<![x", "<?x", "<!x", "<a b='", "<a/", "&a", "<script>", "<script></a "])
def test_time_is_linear_in_the_page(many):
    import time

    begun = time.process_time()
    html_text.main_text("<html><head><title>T</title><body><article><p>Some text.</p>" + many * 100_000)
    assert time.process_time() - begun < 20  # quadratic: hours


def test_comments_that_outweigh_the_article():
    article = "<h1>Title</h1>" + "<p>A sentence, of the article. It is short.</p>" * 3
    comment = "<div class='comment'><p>A comment, that goes on, and on; quite long, really. And so on, for a while.</p></div>"
    for wrap in ("<article>{}</article>", "<main>{}</main>", "<div class=story>{}</div>"):
        page = f"<html><body><nav><a href=/>Home</a></nav>{wrap.format(article)}<section id=comments><h3>Comments</h3>{comment * 30}</section></body></html>"
        assert html_text.main_text(page) == "\n\n".join(["Title", *["A sentence, of the article. It is short."] * 3])
