import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tarnish.llm import exact_dedup, mixing, packing, quality, sharding, simhash
from tarnish.llm.common import Scratch, ranked

from .conftest import words

TOKENIZER = packing.public_tokenizer("word_bpe_49k.json")


def test_ranked_numbers_every_key_from_zero(spark):
    df = spark.range(5000).select(F.when(F.col("id") < 3000, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("k"), "id")
    got = ranked(df, ["k"], [F.desc("id")], Scratch(spark, "test"), "ranks", 7).collect()
    by = defaultdict(list)
    for r in got:
        by[r["k"]].append((r["_rank"], r["id"]))
    for pairs in by.values():
        pairs.sort()
        assert [x for x, _ in pairs] == list(range(len(pairs)))
        assert [i for _, i in pairs] == sorted((i for _, i in pairs), reverse=True)


def brute_targets(sizes, weights=(5, 2, 1), cap=3):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % 3] for k, s in enumerate(order)}
    total, fixed = sum(sizes.values()), {}
    while True:
        open_ = [s for s in order if s not in fixed]
        left = total - sum(fixed.values())
        share = {s: left * w[s] / sum(w[o] for o in open_) for s in open_}
        over = [s for s in open_ if share[s] > cap * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: cap * sizes[s] for s in over}


def test_mix(spark, docs, rows, empty):
    got = mixing.mix(docs, carry=["doc_id", "source"]).collect()
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += len(words(r[1]))
    targets = brute_targets(sizes)
    taken = defaultdict(int)
    assert sorted((r["doc_id"], r["size"]) for r in got) == sorted((r[0], len(words(r[1]))) for r in rows)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(targets[r["source"]])
        assert r["taken"] == r["copies"] * r["size"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - targets[s]) <= max(len(words(r[1])) for r in rows if r[3] == s)
    rate = {s: targets[s] / sizes[s] if sizes[s] else 0 for s in sizes}
    by = defaultdict(int)
    for r in got:
        assert np.floor(rate[r["source"]] - 1e-9) <= r["copies"] <= np.ceil(rate[r["source"]] + 1e-9)
        by[r["source"]] += r["copies"]
    assert all(abs(by[s] - rate[s] * sum(r[3] == s for r in rows)) < 1 for s in sizes)
    again = mixing.mix(docs.repartition(5), carry=["doc_id", "source"]).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    assert mixing.mix(empty).count() == 0


def test_take_gives_each_row_as_often_as_the_mix_says(spark, docs, rows, empty):
    copies = defaultdict(int)
    for r in mixing.mix(docs, carry=["doc_id"]).collect():
        copies[r["doc_id"]] += r["copies"]
    out = mixing.take(docs)
    found = defaultdict(int)
    for r in out.collect():
        assert tuple(r) in rows
        found[r["doc_id"]] += 1
    assert out.columns == docs.columns and found == {d: n for d, n in copies.items() if n}
    assert mixing.take(empty).count() == 0


def test_take_of_repeated_and_null_ids_with_clashing_columns(spark):
    same = [(None, "a b c", "s", i, "k") for i in range(30)] + [(7, "d e f", None, i, "k") for i in range(5)]
    df = spark.createDataFrame([*same, (99, None, None, 0, "k"), (1, "x", "t", 0, "k")], "doc_id long, text string, source string, target int, size string")
    out = mixing.take(df)
    assert out.columns == df.columns
    assert out.count() == mixing.mix(df).agg(F.sum("copies")).first()[0]
    assert max(r["count"] for r in out.groupBy(*df.columns).count().collect()) <= 3


@pytest.mark.parametrize("n", [0, 1, 7, 300, 20_000])
def test_plan_is_a_packing(n):
    lengths = np.clip(np.random.default_rng(n).lognormal(5.5, 1, n).astype(int) + 1, 1, 4096)
    values, counts = np.unique(lengths, return_counts=True)
    plan = packing.plan(dict(zip(values.tolist(), counts.tolist(), strict=True)), 4096)
    if not n:
        assert plan.sequences == 0
        return
    lengths.sort()
    rank = np.arange(n) - np.searchsorted(lengths, lengths)
    sequence, offset = plan.find(lengths, rank)
    check_layout(sequence, offset, lengths)
    assert len(np.unique(sequence)) <= 1.02 * lengths.sum() / 4096 + 2


def check_layout(sequence, offset, length):
    order = np.lexsort((offset, sequence))
    s, o, n = sequence[order], offset[order], length[order]
    new = np.concatenate(([True], s[1:] != s[:-1]))
    assert (o[new] == 0).all() and (o[1:][~new[1:]] == (o + n)[:-1][~new[1:]]).all() and (o + n).max() <= 4096


def test_column_generation_finds_the_least():
    sizes, demand = np.array([6, 4, 3]), np.array([10.0, 10.0, 10.0])
    used = packing.configurations(sizes, demand, 10)
    assert sum(x for _, x in used) == pytest.approx(13.333333, abs=1e-4)
    assert (sum(p * x for p, x in used) >= demand - 1e-6).all()


def test_pack(spark, docs, rows, empty):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(TOKENIZER)
    got = packing.pack(docs, TOKENIZER, with_ids=True).toPandas()
    by = defaultdict(list)
    for r in rows:
        by[r[0]].append([*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 1])
    expected = sorted((d, k, a, ids[a : a + 4096]) for d, docs_ in by.items() for ids in docs_ for k, a in enumerate(range(0, len(ids), 4096)))
    assert sorted((r.doc_id, r.piece, r.start, list(r.ids)) for r in got.itertuples()) == expected
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length for r in got.itertuples())
    check_layout(got.sequence_id.to_numpy(), got.offset.to_numpy(), got.length.to_numpy())
    assert packing.pack(empty, TOKENIZER).count() == 0


@pytest.mark.parametrize("text", ["ΑΣ ΑΣ. İstanbul", "café J̌ <|endoftext|> <|ENDOFTEXT|>", "It's WE'LL x y 12 a\x1cb", "ŁÓDŹ ½ ÀÉ ß", ""])
def test_word_cache_agrees_with_the_tokenizer(text):
    from tokenizers import Tokenizer

    ids = Tokenizer.from_file(TOKENIZER).encode(text, add_special_tokens=False).ids
    assert np.frombuffer(next(packing.token_bytes([text], TOKENIZER)), "<u4").tolist() == ids


def test_shards(spark, docs, rows, empty):
    got = sharding.shard(docs, shards=4, carry=["doc_id", "text"]).collect()
    sizes, slots, homes = defaultdict(int), defaultdict(list), defaultdict(set)
    for r in got:
        assert r["size"] == len((r["text"] or "").encode()) + 16 and r["text_crc32"] == zlib.crc32((r["text"] or "").encode())
        sizes[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        homes[r["text"] or ""].add(r["shard"])
    assert len(got) == len(rows) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    hot = "the of and "
    assert all(len(s) == 1 for t, s in homes.items() if not t.startswith(hot))
    assert sharding.shard(empty).count() == 0


def plain_place(vectors, shards):
    """The rule read plainly: largest first, to the shard with the highest dot product with what it has left."""
    totals = [sum(v[d] for _, v in vectors) for d in range(3)]
    left, out = [[1.0] * 3 for _ in range(shards)], {}
    scaled = [(k, [x * shards / t for x, t in zip(v, totals, strict=True)]) for k, v in vectors]
    for k, v in sorted(scaled, key=lambda kv: (-max(kv[1]), -sum(kv[1]), kv[0])):
        out[k] = max(range(shards), key=lambda s: (round(sum(a * b for a, b in zip(v, left[s], strict=True)), 12), -s))
        left[out[k]] = [a - b for a, b in zip(left[out[k]], v, strict=True)]
    return out


def test_groups_go_where_the_dot_product_is_highest():
    rng = np.random.default_rng(5)
    vectors = [((k,), tuple(float(x) for x in rng.lognormal(3, 1, 3))) for k in range(400)]
    assert sharding.place(vectors, 7) == plain_place(vectors, 7) and sharding.place([], 7) == {}


@pytest.mark.parametrize("ids", ["id", "cast(null as long)", "5L"])
def test_shards_stay_even_with_a_hot_group(spark, ids):
    df = spark.range(30_000).select(F.expr(ids).alias("doc_id"), F.when(F.col("id") % 3 == 0, "same old text").otherwise(F.concat(F.lit("text "), F.col("id"))).alias("text"))
    got = sharding.shard(df).groupBy("shard").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect()
    assert len(got) == 40 and max(r["b"] for r in got) <= 1.03 * min(r["b"] for r in got)


def test_an_id_column_of_a_clashing_name(spark):
    df = spark.createDataFrame([(1, "a b"), (2, "c")], "piece long, text string")
    assert sorted((r["piece_id"], r["piece"]) for r in packing.pack(df, TOKENIZER, id_col="piece").collect()) == [(1, 0), (2, 0)]


def test_equal_rows_are_ranked_in_several_partitions(spark):
    df = spark.range(4000, numPartitions=4).select(F.lit("k").alias("k"), F.lit(1).alias("v"))
    got = ranked(df, ["k"], ["v"], Scratch(spark, "test"), "ranks", 4)
    assert sorted(r["_rank"] for r in got.collect()) == list(range(4000))
    assert got.groupBy(F.spark_partition_id()).count().count() > 1


def test_rejected_documents_go_and_columns_stay(spark):
    text = " ".join(("the", "of")[k % 2] if k % 4 == 0 else f"word{k * 7919 % 1999}" for k in range(300))
    df = spark.createDataFrame([(1, text, "mine", 5), (2, "x", "mine", 5)], "doc_id long, text string, n_words string, kept int")
    assert [tuple(r) for r in quality.drop_rejected(df).collect()] == [(1, text, "mine", 5)]


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    from tarnish import session

    monkeypatch.setattr(session, "on_one_machine", lambda spark: False)
    if spark.conf.get("spark.checkpoint.dir", None) is None:
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            Scratch(spark, "test")


def test_pipeline_stages(spark, tmp_path, docs):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {tuple(r) for r in quality.score(now).where("kept").select(*now.columns).collect()}
    first = corpus_pipeline.quality_rules(spark, now, "")
    assert {tuple(r) for r in first.collect()} == kept
    second = corpus_pipeline.exact_copies(spark, first, "")
    by = {}
    for r in sorted(kept, key=lambda r: r[0]):
        by.setdefault(" ".join((r[1] or "").split()), r)
    assert {tuple(r) for r in second.collect()} == set(by.values())
    third = corpus_pipeline.near_copies(spark, second, "")
    least = {r["component_id"] for r in simhash.near_groups(second, carry=["doc_id"]).collect()}
    assert {r["doc_id"] for r in third.collect()} == least
    fourth = corpus_pipeline.mix_sources(spark, third, "")
    assert fourth.columns == now.columns
    mixed = mixing.mix(third, carry=["doc_id"]).agg(F.sum("copies")).first()[0]
    assert fourth.count() == mixed
    packed = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    assert (packed.piece == 0).sum() == mixed
    check_layout(packed.sequence_id.to_numpy(), packed.offset.to_numpy(), packed.length.to_numpy())
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "exact dedup", "near dedup", "mixing", "packing"]
    assert exact_dedup.drop_copies(third).count() == third.count()
