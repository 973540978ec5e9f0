import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tarnish.llm import bpe, queries
from tarnish.llm.packing import public_tokenizer

PATH = public_tokenizer("byte_bpe_50k.json")
PARTS = ["a", "b", " ", "  ", "\n", "\t", "'s", "'ll", "'", "<|endoftext|>", "<|", "é", "漢", "字", "　", "\xa0", "\x85", "\x1c", "1", "²", "٣", "!", "🎈", "the", "guarantee", "ing", "Ω", " ", "\r\n", "x" * 50]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def merges():
    return bpe.known(PATH)


def ids_of(text, merges):
    return [i for part in bpe.token_ids(text, merges) for i in part]


def test_ids_are_those_of_the_tokenizer(library, merges):
    rng = random.Random(1)
    for _ in range(3000):
        text = "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 14)))
        assert ids_of(text, merges) == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_every_character_has_the_class_that_the_tokenizer_gives_it(library, merges):
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x3400 or c % 97 == 0)]
    text = " x".join(points)
    assert ids_of(text, merges) == library.encode(text, add_special_tokens=False).ids


def test_pieces_far_longer_than_what_is_held(library, merges):
    rng = random.Random(2)
    texts = [c * 20_000 for c in ("x", "=", "ab", "é", "漢")]
    texts += ["".join(rng.choice(["a", "b", "the", "in", "g", "guarant", "ee", "s", "ing", "AB"]) for _ in range(4000)) for _ in range(6)]
    for text in texts:
        assert ids_of(text, merges) == library.encode(text, add_special_tokens=False).ids


def test_transducer_holds_a_bounded_window_whatever_it_is_fed(merges):
    rng = random.Random(3)
    data = "".join(rng.choice(["ing", "s", "guarant", "ee", "x", "th"]) for _ in range(1500)).encode()
    whole = merges.merged(data)
    for size in (1, 7, 5000):
        run, out = bpe.Transducer(merges, 200), []
        for at in range(0, len(data), size):
            out += run.feed(data[at : at + size])
            assert len(run.held) < run.enough
        assert out + run.end() == whole


def brute_merge(word, rules):
    tokens = list(word)
    for a, b in rules:
        out = []
        for t in tokens:
            if out and out[-1] == a and t == b:
                out[-1] = a + b
            else:
                out.append(t)
        tokens = out
    return tokens


def test_lookahead_is_sufficient_for_random_merge_lists():
    rng = random.Random(4)
    for _ in range(60):
        made, rules = ["a", "b", "c"], []
        for _ in range(12):
            a, b = rng.choice(made), rng.choice(made)
            if a + b not in made:
                made.append(a + b)
                rules.append((a, b))
        bound = bpe.sufficient_lookahead(rules)
        for _ in range(60):
            known = "".join(rng.choice("abc") for _ in range(rng.randint(0, 40)))
            ends = []
            for tail in ("", *("".join(rng.choice("abc") for _ in range(rng.randint(1, 10))) for _ in range(3))):
                at, stable = 0, []
                for t in brute_merge(known + tail, rules):
                    at += len(t)
                    if at <= len(known) - bound:
                        stable.append(t)
                ends.append(stable)
            assert all(x == ends[0] for x in ends)


def test_bytes_that_are_no_text_and_ids_that_are_no_token(library, merges):
    rng = random.Random(6)
    for _ in range(300):
        ids = [rng.choice([rng.randrange(256), rng.randrange(50_257)]) for _ in range(rng.randint(0, 30))]
        cut = rng.randint(0, len(ids))
        got = "".join(bpe.text_of([np.array(ids[:cut], np.int32), np.array(ids[cut:], np.int32)], merges))
        assert got == library.decode(ids, skip_special_tokens=False)
    assert "".join(bpe.text_of([np.array([99_999, 64], np.int32)], merges)) == library.decode([64])


def test_round_trip_over_a_table(spark, docs, rows, library):
    coded = bpe.encode(docs.withColumn("ids", F.lit("clash")), PATH)
    assert coded.columns == ["doc_id", "lang", "source", "n_chars", "ids"]
    back = bpe.decode(coded, PATH, carry=["doc_id", "ids"]).collect()
    by_text = {}
    for r in rows:
        by_text.setdefault(r[0], []).append(r[1] or "")
    assert len(back) == len(rows)
    for r in back:
        assert r["decoded"] in by_text[r["doc_id"]]
        assert r["ids"] == library.encode(r["decoded"], add_special_tokens=False).ids


def test_nulls_and_empty_tables(spark, empty):
    assert bpe.decode(bpe.encode(empty, PATH), PATH).count() == 0
    odd = spark.createDataFrame([(None, None), (1, ""), (1, ""), (2, "<|endoftext|>")], "doc_id long, text string")
    got = bpe.decode(bpe.encode(odd, PATH), PATH).collect()
    assert sorted((r["doc_id"] or 0, r["ids"], r["decoded"]) for r in got) == [(0, [], ""), (1, [], ""), (1, [], ""), (2, [50256], "<|endoftext|>")]
    ids = spark.createDataFrame([(None,), ([64, None, 70_000],)], "ids array<int>")
    assert sorted(r["decoded"] for r in bpe.decode(ids, PATH).collect()) == ["", "a"]


def test_query_over_the_whole_table(spark, library):
    path = "/root/testdata/sf0.001"
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = {}
    for r in spark.read.parquet(f"{path}/documents.parquet").collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        want[r["doc_id"]] = (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))
    got = queries.op11_bpe(spark, path).collect()
    assert {r["doc_id"]: tuple(r)[1:] for r in got} == want and len(got) == len(want)
