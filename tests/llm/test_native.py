"""Mixing, exact dedup, sharding, quality rules: brute force, edge cases and laws."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import common, exact_dedup, mixing, quality_rules, queries, sharding

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], DOCS)


def saved(df, tmp_path, name="documents"):
    path = str(tmp_path / f"{name}.parquet")
    df.write.mode("overwrite").parquet(path)
    return path


ODD = [(1, None, "a"), (2, "", "a"), (3, "  \n\t", None), (4, "one two", "b"), (4, "one two", "b"), (None, "one two", None), (5, "x " * 30000, "a"), (6, "é　ß one", "é"), (7, "one two", "a")]


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_against_sql(spark, sf, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    df = queries.QUERIES[name](spark, sf)
    want = con.sql(queries.ORACLE_SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    assert sorted(tuple(r[c] for c in columns) for r in df.collect()) == sorted(tuple(r[i] for i in at) for r in want.fetchall())


# ---- mixing


def brute_targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted((k for k in sizes if k is not None)) + ([None] if None in sizes else [])
    weight = {k: weights[i % 3] for i, k in enumerate(names)}
    total, held = sum(sizes.values()), {}
    while True:
        free = [k for k in names if k not in held]
        share = {k: (total - sum(held.values())) * weight[k] / sum(weight[x] for x in free) for k in free} if free else {}
        over = [k for k in free if share[k] > most * sizes[k]]
        if not over:
            return held | share
        held |= {k: most * sizes[k] for k in over}


def test_mixing_laws(spark):
    rows = [(i, "w " * (i % 40), f"s{i % 3}" if i % 7 else None) for i in range(2000)] + [(9000 + i, "w " * 10, "tiny") for i in range(3)]
    out = mixing.mix_documents(docs(spark, rows)).collect()
    sizes = defaultdict(int)
    source = {i: s for i, _, s in rows}
    for r in out:
        sizes[source[r.doc_id]] += r.size
    targets = brute_targets(dict(sizes))
    taken, largest = defaultdict(int), defaultdict(int)
    for r in out:
        s = source[r.doc_id]
        assert r.size == len(WORD.findall("w " * (r.doc_id % 40) if r.doc_id < 9000 else "w " * 10))
        assert r.source_size == sizes[s] and abs(r.target - targets[s]) < 1e-6 and 0 <= r.taken <= 3 * r.size
        taken[s] += r.taken
        largest[s] = max(largest[s], r.size)
    assert all(abs(taken[s] - targets[s]) <= largest[s] for s in sizes)
    again = mixing.mix_documents(docs(spark, rows[::-1])).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, out))


def test_mixing_edges(spark):
    out = mixing.mix_documents(docs(spark, ODD)).collect()
    assert len(out) == len(ODD) and {r.size for r in out} == {0, 2, 30000, 3 - 1}
    assert mixing.mix_documents(docs(spark, [])).collect() == []
    assert [r.taken for r in mixing.mix_documents(docs(spark, [(1, None, None)])).collect()] == [0]


def test_repeated_rows_share_the_rest(spark):
    rows = [(1, "w " * 10, "a")] * 50 + [(2, "w " * 100, "b")]
    out = mixing.mix_documents(docs(spark, rows)).collect()
    a = [r for r in out if r.doc_id == 1]
    assert len({r.taken for r in a}) == 1 and abs(sum(r.taken for r in a) - a[0].target) <= 50


def test_mixed_rows_keep_columns_and_repeat(spark):
    rows = [(i, "w " * 20, "a") for i in range(40)] + [(100 + i, "w " * 20, "b") for i in range(400)]
    df = docs(spark, rows).withColumn("size", F.lit("clash")).withColumn("h", F.lit(1))
    out = mixing.mixed_rows(df)
    assert out.columns == df.columns
    got = Counter(r.doc_id for r in out.collect())
    want = {r.doc_id: r.copies for r in mixing.mix_documents(df).collect() if r.copies}
    assert got == want and max(got.values()) == 3


# ---- exact dedup


def test_paths_as_patterns():
    assert exact_dedup.as_pattern("/a/docs.parquet") == "/a/docs.parque[t]" == exact_dedup.as_pattern("/a/docs.parquet/")
    assert exact_dedup.as_pattern("/a/x-") == "/a/x{-}" and exact_dedup.as_pattern("/a/*") == "/a/*"


@pytest.mark.parametrize("name", ["plain", "with space", "end-"])
def test_dedup_of_odd_paths(spark, tmp_path, name):
    path = str(tmp_path / name)
    docs(spark, [(1, "a", "s"), (2, "a", "s")]).write.parquet(path)
    assert sorted((r.doc_id, r.keep_id) for r in exact_dedup.dedup_files(spark, path).collect()) == [(1, 2), (2, 2)]


def test_a_stream_goes_on_from_its_checkpoint(spark, tmp_path):
    path, folder = str(tmp_path / "in"), common.shared_folder(spark, "stream")
    docs(spark, [(1, "a", "s"), (2, "b", "s")]).write.parquet(path)
    exact_dedup.stream_state(spark, path, folder)
    docs(spark, [(3, "a", "s"), (4, "c", "s")]).write.mode("append").parquet(path)
    state = exact_dedup.stream_state(spark, path, folder).collect()
    assert sorted((r.keeper.doc_id, r.n) for r in state) == [(2, 1), (3, 2), (4, 1)]


def brute_dedup(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    return {t: (max(v), len(v)) for t, v in groups.items()}


@pytest.mark.parametrize("digest", [exact_dedup.sha, lambda t: F.crc32(t).cast("string").substr(1, 1).cast("binary")], ids=["sha256", "colliding"])
@pytest.mark.parametrize("batch", [1, 1 << 30])
def test_dedup_is_exact_whatever_the_digest_and_the_batches(spark, tmp_path, digest, batch):
    rows = [(i, f"text {i % 7}", "s") for i in range(60)] + [(100, None, "s"), (101, "", "s"), (102, "text 1 ", "s")]
    path = saved(docs(spark, rows).repartition(4), tmp_path)
    out = exact_dedup.dedup_files(spark, path, digest=digest, batch_bytes=batch).collect()
    want = brute_dedup([(i, t) for i, t, _ in rows])
    text = {i: t or "" for i, t, _ in rows}
    assert len(out) == len(rows)
    for r in out:
        keep, n = want[text[r.doc_id]]
        assert (r.keep_id, r.group_size, r.kept) == (keep, n, r.doc_id == keep)
        assert r.text_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest()


def test_dedup_edges(spark, tmp_path):
    path = saved(docs(spark, ODD), tmp_path)
    out = exact_dedup.dedup_files(spark, path).collect()
    same = [r for r in out if r.text_sha256 == hashlib.sha256(b"one two").hexdigest()]
    assert len(same) == 4 and {r.keep_id for r in same} == {7} and sum(r.kept for r in same) == 1
    path = saved(docs(spark, [(4, "a", "s")] * 5), tmp_path)
    assert sorted(r.kept for r in exact_dedup.dedup_files(spark, path).collect()) == [False] * 4 + [True]
    path = saved(docs(spark, []), tmp_path)
    assert exact_dedup.dedup_files(spark, path).collect() == []


def test_without_copies_keeps_rows_whole(spark, tmp_path):
    df = docs(spark, ODD).withColumn("kept", F.lit("clash"))
    out = exact_dedup.without_copies(df)
    assert out.columns == df.columns
    assert sorted(r.text or "" for r in out.collect()) == sorted({t or "" for _, t, _ in ODD})
    again = exact_dedup.without_copies(spark.read.parquet(saved(df, tmp_path)))
    assert again.count() == out.count()


def test_state_is_kept_in_rocksdb_and_settings_are_restored(spark, tmp_path):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    exact_dedup.dedup_files(spark, saved(docs(spark, ODD), tmp_path)).count()
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before
    assert common.source_folder(spark.read.parquet(str(tmp_path / "documents.parquet"))) is not None
    assert common.source_folder(spark.range(3)) is None


# ---- sharding


def test_shards_are_even_gapless_and_shuffled(spark):
    rows = [(i, f"text {i}" * (i % 30), "s") for i in range(3000)]
    df = docs(spark, rows).repartition(3)
    size = sharding.document_size(F.col("text"))
    out = sharding.shard_records(df, 40, 1, size, bucket_bytes=20_000)
    assert out.columns == [*df.columns, "__shard", "__slot"]
    got = out.collect()
    assert sorted(r.doc_id for r in got) == list(range(3000))
    slots = defaultdict(list)
    for r in got:
        slots[r["__shard"]].append(r["__slot"])
    counts = [len(slots[k]) for k in range(40)]
    assert max(counts) - min(counts) <= 1 and all(sorted(v) == list(range(len(v))) for v in slots.values())
    order = [r.doc_id for r in sorted(got, key=lambda r: (r["__slot"], r["__shard"]))]
    assert sum(abs(a - b) for a, b in zip(order, order[1:], strict=False)) / 3000 > 500
    other = {r.doc_id: r["__shard"] for r in sharding.shard_records(df, 40, 2, size, bucket_bytes=20_000).collect()}
    assert sum(other[r.doc_id] == r["__shard"] for r in got) < 300


def test_sharding_edges_and_files(spark, tmp_path):
    df = docs(spark, ODD + [(9, "same", "s")] * 300)
    size = sharding.document_size(F.col("text"))
    out = sharding.shard_records(df, 7, 3, size)
    got = Counter(r["__shard"] for r in out.collect())
    assert max(got.values()) - min(got.values()) <= 1 and sum(got.values()) == len(ODD) + 300
    assert sharding.shard_records(docs(spark, []), 7, 3, size).count() == 0
    sharding.write_shards(common.written(out, "t"), str(tmp_path / "out"), 7)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == len(ODD) + 300 and back.select("__shard").distinct().count() == 7


def test_sharding_query(spark, sf):
    rows = queries.op2_sharding(spark, sf).collect()
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in rows:
        data = (text[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(data) + 16, zlib.crc32(data), "rows", None)


# ---- quality rules


def brute_rules(text):
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    marked = {i + k for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(marked)


def test_base_counts(spark):
    texts = ["a b c a b c", "x x x x", "x x x", "#a|b <c>\n#a|b <c>\n\n \nq", "é ß 日本 é ß 日本 z", "one\x0btwo\x0cthree four", "a b c d " * 400, "", "a\nb\nc\na\nb\nc"]
    rows = [(i, t, "s") for i, t in enumerate(texts)] + [(99, None, None)]
    out = {r.doc_id: r for r in quality_rules.quality_rules(docs(spark, rows)).collect()}
    for i, t in enumerate([*texts]):
        r = out[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_rules(t), t
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
    assert out[99].base_failed and not out[99].kept


def test_common_lines_deplete_documents(spark):
    body = lambda i: " ".join(f"w{i}x{k}" for k in range(60))
    shared = " ".join(f"shared{k}" for k in range(55))
    rows = [(i, f"{shared}\n{body(i)}", "h") for i in range(30)] + [(100 + i, f"{shared.upper()}\nown{i}", "h") for i in range(5)] + [(200, f"{shared}\nmine", "other")]
    rows += [(300 + i, " ".join(f"copy{k}" for k in range(60)), "h") for i in range(40)]
    out = {r.doc_id: r for r in quality_rules.quality_rules(docs(spark, rows), line_share=0.1).collect()}
    assert all(out[i].kept and out[i].words_left == 60 for i in range(30))
    assert all(not out[100 + i].kept and not out[100 + i].base_failed for i in range(5))
    assert out[200].kept
    assert all(out[300 + i].kept for i in range(40))  # copies of one text are one document
    assert quality_rules.quality_rules(docs(spark, [])).collect() == []
    assert len(quality_rules.quality_rules(docs(spark, ODD)).collect()) == len(ODD)


# ---- shared


def test_bucket_starts_by_blocks(spark):
    counts = [(k, (k * 7) % 5 + 1) for k in range(40) if k % 6]
    out = sharding.bucket_starts(spark.createDataFrame(counts, "__bucket long, n long"), each=4).collect()
    assert {r["__bucket"]: r["__start"] for r in out} == {k: sum(n for j, n in counts if j < k) for k, _ in counts}


def test_a_record_larger_than_its_bucket(spark):
    rows = [(i, "x" * (5000 if i == 7 else 3), "s") for i in range(50)]
    size = sharding.document_size(F.col("text"))
    out = sharding.shard_records(docs(spark, rows), 4, 3, size, bucket_bytes=500).collect()
    assert sorted(r.doc_id for r in out) == list(range(50))
    assert sorted((r["__shard"], r["__slot"]) for r in out) == sorted((k % 4, k // 4) for k in range(50))


def test_shards_in_several_files(spark, tmp_path):
    rows = [(i, f"t{i}", "s") for i in range(300)]
    out = common.written(sharding.shard_records(docs(spark, rows), 3, 1, sharding.document_size(F.col("text"))), "t")
    sharding.write_shards(out, str(tmp_path / "out"), 3, files_a_shard=4)
    for k in range(3):
        files = sorted((tmp_path / "out" / f"__shard={k}").glob("part-*.parquet"))
        slots = [r["__slot"] for f in files for r in spark.read.parquet(str(f)).collect()]
        assert slots == list(range(100)) and len(files) > 1


def test_salted_lines_are_the_same(spark):
    rows = [(i, "common line here\n" + f"own {i} " * (i % 5), "a" if i % 3 else None) for i in range(60)]
    counted = common.written(quality_rules.document_counts(docs(spark, rows)), "t")
    lines = quality_rules.frequent_lines(counted, 10, 0.005)
    assert lines.count() == 2
    both = [sorted((r.row, r.removed) for r in quality_rules.removed_lines(counted, lines, broadcast=n, salts=3).collect()) for n in (100, 0)]
    assert both[0] == both[1] and len(both[0]) == 60


def test_cleaned_documents_lose_their_frequent_lines(spark):
    own = lambda i: " ".join(f"w{i}x{k}" for k in range(60))
    rows = [(i, f"Common  LINE here\n{own(i)}\n\ncommon line here", "a") for i in range(30)] + [(90, "too short", "a"), (91, None, None)]
    df = docs(spark, rows).withColumns({"row": F.lit("clash"), "gone": F.lit(1), "document": F.lit("x")})
    out = quality_rules.clean_documents(df)
    assert out.columns == df.columns
    assert {r.doc_id: r.text for r in out.collect()} == {i: f"{own(i)}\n" for i in range(30)}


def test_tables_on_the_way_are_deleted(spark):
    made = []

    def make():
        made.append(common.shared_folder(spark, "t"))
        spark.range(3).write.parquet(made[0])
        return spark.read.parquet(made[0])

    out = common.settled(spark, make, "out")
    assert out.count() == 3
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(made[0])
