import hashlib
import random
import re

import numpy as np
from pyspark.sql import functions as F

from tarnish.llm import fim, queries

UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]", re.DOTALL)


def brute(doc_id, text, seed=1):
    text = text or ""
    units = UNIT.findall(text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = ("".join(x) for x in (units[:low], units[low:high], units[high:]))
    if h[3] % 100 < 20:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


EDGES = [None, "", " ", "a", "<P>", "x<S>y", "<M", "<<P", "ends <", "P>S>", "Ünï cödé", "漢字 🎈 x", "a" * 70_000, "ab1 " * 40_000, "🎈" * 5000, "\n\r\n", "<" * 50]


def test_agrees_with_cutting_into_units(spark, docs, rows):
    more = [(10_000 + k, EDGES[k % len(EDGES)]) for k in range(30 * len(EDGES))] + [(None, "no id here"), (7, "same id"), (7, "same id")]
    data = spark.createDataFrame([(r[0], r[1]) for r in rows] + more, "doc_id long, text string").repartition(3)
    got = fim.transform(data.withColumn("key", F.coalesce("text", F.lit("-"))), text="key").withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    assert len(got) == len(rows) + len(more)
    seen = set()
    for r in got:
        text = r["text"] if r["text"] is not None else "-"
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == brute(r["doc_id"], text)
        assert r["back"] == text
        seen.add(r["form"])
    assert seen == {"plain", "psm", "spm"}


def test_chunks_and_blocks_of_any_size_give_the_same_cuts():
    rng = random.Random(5)
    texts = ["".join(rng.choice(["a", "B", "cd", " ", "1", "é", "漢", "🎈", "<"]) for _ in range(rng.choice((0, 1, 7, 60, 400)))) for _ in range(40)]
    raw = [t.encode() for t in texts]
    ends = np.concatenate([[0], np.cumsum([len(x) for x in raw])])
    data = np.frombuffer(b"".join(raw), np.uint8)
    for chunk, block in ((1, 1), (3, 7), (16, 16), (64, 1000), (4096, 1 << 22)):
        cuts = fim.Cuts(data, ends, chunk, block)
        for k, text in enumerate(texts):
            units = UNIT.findall(text)
            assert cuts.n[k] == len(units)
            for rank in {0, 1, len(units) // 2, max(len(units) - 1, 0), len(units)}:
                head = "".join(units[:rank])
                assert cuts.place(k, rank) == (len(head.encode()), len(head))


def test_nulls_empty_tables_and_clashing_columns(spark, empty):
    assert fim.transform(empty).count() == 0
    odd = spark.createDataFrame([(None, None, "keep", 5, [1, 2]), (None, None, "keep", 5, [1, 2])], "doc_id long, text string, output string, n int, extra array<int>")
    got = fim.transform(odd).collect()
    assert [(r["doc_id"], r["n"], r["form"], r["output"], r["extra"]) for r in got] == [(None, 0, "plain", "", [1, 2])] * 2


def test_query_over_the_whole_table(spark):
    path = "/root/testdata/sf0.001"
    want = {}
    for r in spark.read.parquet(f"{path}/documents.parquet").collect():
        n, form, prefix, middle, output = brute(r["doc_id"], r["text"])
        want[r["doc_id"]] = (n, form, prefix, middle, hashlib.sha256(output.encode()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest())
    got = queries.op13_fim(spark, path).collect()
    assert {r["doc_id"]: tuple(r)[1:] for r in got} == want and len(got) == len(want)
