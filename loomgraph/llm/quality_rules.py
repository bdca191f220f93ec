"""Quality rules with cross-document line frequency.

Each document gets its base counts. Its lines are normalised and hashed; for every host the number
of distinct documents with a line is counted, lines in more documents than the limit are removed,
and a document that keeps too few of its words is rejected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE, WORD, let, named, text_of, written

SYMBOLS = "#*$%&|<>"
FEWEST_WORDS = 50
#: Percent of a text's words that may stand in repeated windows.
MOST_REPEATED = 50
WINDOW = 3
#: A line is boilerplate of its host in more documents than both limits.
LINE_DOCUMENTS = 10
LINE_SHARE = 0.005
#: Frequent lines that are broadcast at most (a host and a number each); salts of the join beyond it.
BROADCAST_LINES = 500_000
SALTS = 64
#: A document is rejected if fewer of its words are left.
LEAST_LEFT = 0.3


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """How many words stand in windows found twice or more in the text, the first one included.

    Windows are hashed and sorted with their places; equal neighbours are repeats, and the union of
    their spans is counted, so the cost is that of a sort whatever repeats.
    """

    def spans(s: Column) -> Column:
        n = F.size(s)
        twin = lambda e, i: ((i > 0) & (F.get(s, i - 1)["h"] == e["h"])) | ((i < n - 1) & (F.get(s, i + 1)["h"] == e["h"]))
        return F.sort_array(F.transform(F.filter(s, twin), lambda e: e["i"]))

    def covered(p: Column) -> Column:
        n = F.size(p)
        gaps = F.zip_with(F.slice(p, 1, F.greatest(n - 1, F.lit(0))), F.slice(p, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: F.least(b - a, F.lit(window)))
        return F.when(n == 0, F.lit(0)).otherwise(F.aggregate(gaps, F.lit(window), lambda a, x: a + x))

    def of(w: Column) -> Column:
        n = F.size(w)
        hashes = F.transform(F.sequence(F.lit(1), n - (window - 1)), lambda i: F.xxhash64(*[F.element_at(w, (i + k).cast("int")) for k in range(window)]))
        marked = lambda g: F.sort_array(F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        repeats = let(hashes, lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(let(let(marked(g), spans), covered)))
        return F.when(n < window, F.lit(0)).otherwise(repeats)

    return let(words, of).cast("long")


def normalised(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(line), r"[\x20\x09-\x0D]+", " "))


def line_hash(line: Column) -> Column:
    return F.xxhash64(normalised(line))


def document_counts(docs: DataFrame, host: str = "source", whole: bool = False) -> DataFrame:
    """One row per document: its base counts, a key of its text, and (hash, words) of its lines; with
    ``whole`` all its columns, as a struct."""
    text = text_of()
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, WHITE, "")) > 0)
    document = [F.struct(*named(docs.columns)).alias("document")] if whole else []
    out = docs.select("doc_id", F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"), text.alias("text"), *document)
    out = out.select("doc_id", "host", "text", words_of(F.col("text")).alias("words"), lines.alias("lines"), *[c for c in out.columns if c == "document"])
    bare = F.translate("text", WHITE, "")
    return out.select(
        "doc_id",
        "host",
        F.monotonically_increasing_id().alias("row"),
        F.xxhash64("text").alias("text_key"),
        F.size("words").cast("long").alias("n_words"),
        F.length(bare).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
        F.transform("lines", lambda x: F.struct(line_hash(x).alias("h"), F.size(words_of(x)).alias("n"))).alias("lines"),
        *[c for c in out.columns if c == "document"],
    )


def frequent_lines(counted: DataFrame, line_documents: int, line_share: float) -> DataFrame:
    """(host, h) of the lines over the limits, a written table: lines of distinct texts are counted."""
    distinct = counted.select("host", "text_key", F.explode(F.array_distinct(F.transform("lines", lambda x: x["h"]))).alias("h")).distinct()
    by_line = distinct.groupBy("host", "h").agg(F.count(F.lit(1)).alias("documents"))
    by_host = counted.select("host", "text_key").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("all_documents"))
    limit = F.greatest(F.lit(float(line_documents)), F.col("all_documents") * line_share)
    common = by_line.filter(F.col("documents") > line_documents).join(by_host, "host").filter(F.col("documents") > limit).select("host", "h")
    return written(common, "rules-lines")


def removed_lines(counted: DataFrame, common: DataFrame, broadcast: int = BROADCAST_LINES, salts: int = SALTS) -> DataFrame:
    """(row, removed, gone): words and hashes of a document's lines that are frequent. Where the frequent
    lines are too many to broadcast, the join on them is salted, as each is in many documents."""
    lines = counted.select("row", "host", F.explode("lines").alias("line")).select("row", "host", F.col("line.h").alias("h"), F.col("line.n").alias("n"))
    if common.limit(broadcast + 1).count() <= broadcast:
        found = lines.join(F.broadcast(common), ["host", "h"])
    else:
        salted = common.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        found = lines.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(salts)).cast("int")).join(salted, ["host", "h", "salt"])
    return found.groupBy("row").agg(F.sum("n").alias("removed"), F.collect_set("h").alias("gone"))


def quality_rules(
    docs: DataFrame,
    host: str = "source",
    line_documents: int = LINE_DOCUMENTS,
    line_share: float = LINE_SHARE,
    least_left: float = LEAST_LEFT,
    fewest_words: int = FEWEST_WORDS,
    most_repeated: int = MOST_REPEATED,
    whole: bool = False,
) -> DataFrame:
    """One row per row of documents(doc_id, text, host): n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, words_left, kept; with ``whole`` also ``document`` (all its columns)
    and ``gone`` (hashes of its removed lines).

    Documents with the same text count once in a line's frequency, so copies of one text don't make
    its lines boilerplate. Null texts count as empty (and fail: no words); null hosts are one host;
    repeated rows are judged alike; an empty table gives an empty result; columns may have any names.
    """
    counted = written(document_counts(docs, host, whole), "rules-documents")
    common = frequent_lines(counted, line_documents, line_share)
    out = counted.drop("lines", "text_key").join(removed_lines(counted, common), "row", "left")
    failed = (F.col("n_words") < fewest_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))
    left = F.col("n_words") - F.coalesce("removed", F.lit(0))
    out = out.withColumns({"base_failed": failed, "words_left": left})
    kept = ~F.col("base_failed") & (F.col("words_left") >= least_left * F.col("n_words"))
    return out.withColumn("kept", kept).drop("row", "host", "removed", *([] if whole else ["gone"]))


def clean_documents(docs: DataFrame, host: str = "source", **limits) -> DataFrame:
    """The documents that the rules keep, with all their columns; their texts without the removed lines.
    Edge cases as in quality_rules."""
    found = quality_rules(docs, host, whole=True, **limits).filter("kept")
    stays = lambda x: (F.length(F.translate(x, WHITE, "")) == 0) | ~F.array_contains(F.col("gone"), line_hash(x))
    cleaned = F.when(F.col("gone").isNull(), F.col("document")["text"]).otherwise(F.array_join(F.filter(F.split(F.col("document")["text"], "\n"), stays), "\n"))
    fields = [cleaned.alias(c) if c == "text" else F.col("document").getField(c).alias(c) for c in docs.columns]
    return found.select(*fields)
