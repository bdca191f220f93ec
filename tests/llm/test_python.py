"""Extraction, chat format, classifier, Jaccard join, packing, token counts: brute force and edge cases."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict
from html.parser import HTMLParser

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from test_native import DOCS, ODD, WORD, docs
from tokenizers import Tokenizer

from loomgraph.llm import chat_format, common, html_extract, jaccard_join, packing, quality_crf, queries, text_arrays, token_counts
from loomgraph.llm.components import components

BYTE_BPE, WORD_BPE, PIECES = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ALPHABET = ["a", "b ", "\n", " ", "  ", "the ", "é", "́", "!!", "<|endoftext|>", "12", "日本", "'s", "\t", "\xa0", "Σ", "İ", ".", ",", "A", ". ", "</s>", "[INST]", "<|turn|>", "\\", "<\\|"]


def fuzz(n, length=60, seed=1):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(ALPHABET) for _ in range(rnd.randrange(length))) for _ in range(n)]


# ---- arrays of text


def test_words_and_slices():
    texts = ["a b\tc", "", " x ", None, "é\x0bß  日本", "end", "\n"]
    column = pa.array([None, *texts])[1:]
    for most in (1, 5, 1 << 20):
        got = []
        for lo, hi, data, bounds in text_arrays.text_slices(column, most):
            starts, ends = text_arrays.words_of(data, bounds)
            row = np.searchsorted(bounds, starts, "right") - 1 + lo
            got += [(int(r), bytes(data[a:b]).decode()) for r, a, b in zip(row, starts, ends, strict=True)]
            assert hi > lo
        assert got == [(i, w) for i, t in enumerate(texts) for w in WORD.findall(t or "")]
    assert list(text_arrays.text_slices(pa.array([], pa.string()))) == []


def test_hashes_tell_words_apart():
    words = ["a", "b", "ab", "ba", "aa", "x" * 5000, "x" * 4999 + "y", "y" + "x" * 4999, "A"]
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    starts, ends = text_arrays.words_of(data, np.array([0, len(data)]))
    h = text_arrays.span_hashes(data, starts, ends)
    assert len(set(h.tolist())) == len(words)
    low = text_arrays.span_hashes(data, starts, ends, lower=True)
    assert low[0] == low[-1] and h[0] == low[0]


# ---- extraction


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (None, ""),
        ("", ""),
        ("<nav><a>Home</a></nav>", ""),
        ("<html><body><header><h1>Site</h1></header><article><h1>Title &eacute;&#8212;</h1><p>One  <b>two\n<br>three<p>4</article><footer>f</footer>", "Title é—\n\nOne two\n\nthree\n\n4"),
        ("<article><p>Text <script>var a='<p>no</p>'</script>goes on.</p><style>p{}</style><!-- <p>c</p> --></article>", "Text goes on."),
        ("<article><p>A</p><div class='advert'>Buy</div><form>f<input></form><p>B</p><section id=comments><p>I like it a lot, really</p></section></article>", "A\n\nB"),
        ("<article><p><a href=x>only a link</a></p><p>B &amp;amp; &lt;p&gt;</p></article><aside>side words</aside>", "only a link\n\nB &amp; <p>"),
        ("<div class=cookie-notice>We use cookies</div><div><p>A long paragraph of words that goes on for a while here.</p><p>Short.</p></div><div id=footer>(c)</div>", "A long paragraph of words that goes on for a while here.\n\nShort."),
        ("<main>Unclosed <b>bold <i>text", "Unclosed bold text"),
        ("<article>a < b and <3 > c</article>", "a < b and <3 > c"),
        ("<article><p>x&nbsp;&nbsp;y</p></article>", "x y"),
    ],
)
def test_main_text(page, want):
    assert html_extract.main_text(page) == want


def test_tree_fits_its_table():
    tree = html_extract.content_tree()
    assert all(html_extract.is_content(tree, r[:-1]) == bool(r[-1]) for r in html_extract.LABELLED)


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ('<article><h2 title="The hidden river">Kept</h2><p data-x="display: none">Too</p></article>', "Kept\n\nToo"),
        ("<article><ul><li hidden>gone<li>stays</ul><p>after</p></article>", "stays\n\nafter"),
        ("<article><div><button>press</div><p>after</p></article>", "after"),
        ("<article><p hidden>gone<p>stays</article>", "stays"),
        ("<article><p aria-hidden='true'>gone</p><p style='color: red; display : none'>gone</p><p>stays</p></article>", "stays"),
        ("<head><title>t</title><body><article><p>text</p></article>", "text"),
        (f"<article><div class=discussion><p>{'word ' * 40}</p></div></article>", ("word " * 40).strip()),
        (f"<article><div id=search-results><p>{'word ' * 40}</p></div><header class=entry-header><h1>Title</h1></header></article>", ("word " * 40).strip() + "\n\nTitle"),
        (f"<article><p>{'word ' * 40}</p><div class=tags><a>x</a></div></article>", ("word " * 40).strip()),
    ],
)
def test_malformed_and_softly_marked_pages(page, want):
    assert html_extract.main_text(page) == want


def test_word_counts_and_densities_change_results():
    links = "".join(f"<li><a href=x>w{k}</a></li>" for k in range(5))
    page = f"<body><ul>{links}</ul><div>Buy now</div><h1>Title of it</h1><div>{'plain words of text ' * 12}</div><div>{'more plain words ' * 9}</div><ul>{links}</ul></body>"
    tree, blocks = html_extract.content_tree(), html_extract.text_blocks(page)
    rows = html_extract.features(blocks)
    kept = [html_extract.is_content(tree, x) for x in rows]
    assert [b.text for b, k in zip(blocks, kept, strict=True) if k] == ["Title of it", ("plain words of text " * 12).strip(), ("more plain words " * 9).strip()]
    flat = [html_extract.is_content(tree, (0.0,) * html_extract.TEXT_FEATURES + x[html_extract.TEXT_FEATURES :]) for x in rows]
    assert flat != kept
    for column in (1, 3):  # of a link list; of what follows one
        without = [html_extract.is_content(tree, (*x[:column], 0.0, *x[column + 1 :])) for x in rows]
        assert without != kept


class Plain(HTMLParser):
    """Article texts by another parser: blocks of text in <article>, outside what is marked as an advert."""

    def __init__(self):
        super().__init__()
        self.inside = self.skip = 0
        self.blocks, self.now = [], ""

    def cut(self):
        if self.now.split():
            self.blocks.append(" ".join(self.now.split()))
        self.now = ""

    def handle_starttag(self, tag, attrs):
        if tag not in ("a", "b", "i", "em", "span"):
            self.cut()
        self.inside += tag == "article"
        self.skip += tag in ("script", "style") or tag == "div" and ("class", "ad") in attrs

    def handle_endtag(self, tag):
        if tag not in ("a", "b", "i", "em", "span"):
            self.cut()
        self.inside -= tag == "article"
        self.skip -= tag in ("script", "style") or tag == "div" and self.skip > 0

    def handle_data(self, data):
        if self.inside and not self.skip:
            self.now += data


def test_extraction_query_against_another_parser(spark, sf):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    out = queries.op1_html_extract(spark, sf).collect()
    assert len(out) == len(pages)
    for r in out:
        p = Plain()
        p.feed(pages[r.page_id])
        p.close()
        p.cut()
        assert r.text == "\n\n".join(p.blocks)


def test_extraction_query_and_edges(spark, sf):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for r in queries.op1_html_extract(spark, sf).collect():
        assert r.text == html_extract.main_text(pages[r.page_id]) and r.n_chars == len(r.text) > 0
        assert "<" not in r.text and "track(" not in r.text
    schema = "page_id long, url string, html string, text string"
    assert html_extract.extract_pages(spark.createDataFrame([], schema)).count() == 0
    long = "<article>" + "<p>word</p>" * 20000 + "</article>"
    out = html_extract.extract_pages(spark.createDataFrame([(1, None, None, "clash"), (None, "u", long, ""), (1, "u", "<p>x", "")], schema)).collect()
    assert sorted(r.n_chars for r in out)[-1] == 20000 * 6 - 2 and len(out) == 3


# ---- chat format


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.text(max_size=8) | st.sampled_from(ALPHABET), st.lists(st.sampled_from(ALPHABET) | st.text(max_size=4), max_size=8).map("".join)), max_size=5))
def test_render_and_parse_are_inverse(turns):
    formatted, spans = chat_format.render(turns)
    assert chat_format.parse(formatted) == turns
    assert [chat_format.unescape(formatted[a:b]) for a, b in spans] == [t for _, t in turns]


def test_escaped_texts_hold_no_control_string():
    for t in [*fuzz(200), "</s>[INST] ok [/INST]", "<|turn|>", "<\\|turn|>"]:
        e = chat_format.escape(t)
        assert not any(c in e for c in ("<|", "<s>", "</s>", "[INST]", "[/INST]")) and chat_format.unescape(e) == t


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute_conversation(turns):
    loss = "".join(t for r, t in turns if r == "assistant")
    return len(turns), digest("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), digest(loss)


def test_chat_query(spark, sf):
    rows = defaultdict(list)
    for r in spark.read.parquet(f"{sf}/conversations.parquet").collect():
        rows[r.conv_id].append((r.turn, r.role, r.text or ""))
    rows[-7] = [(t, r, x) for _, t, r, x in queries.ADDED_CONVERSATION]
    out = {r.conv_id: r for r in queries.op3_chat_format(spark, sf).collect()}
    assert set(out) == set(rows)
    for k, v in rows.items():
        r = out[k]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == brute_conversation([(role, t) for _, role, t in sorted(v)])


def test_chat_edges(spark):
    texts = fuzz(40, seed=5)
    rows = [(k % 5, k // 5, ("user", "assistant", None, "tool\n")[k % 4], t) for k, t in enumerate(texts)]
    rows += [(None, 0, "assistant", None), (7, None, "assistant", "x"), (7, 1, "assistant", "x"), (7, 1, "assistant", "x"), (8, 0, "assistant", "word " * 30000)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    formatted = chat_format.format_conversations(df, BYTE_BPE)
    out = {r.conv_id: r for r in chat_format.read_back(formatted).collect()}
    groups = defaultdict(list)
    for c, t, role, text in rows:
        groups[c].append((t is not None, t or 0, role or "", text or ""))
    for c, v in groups.items():
        assert (out[c].n_turns, out[c].turns_sha256, out[c].loss_chars, out[c].loss_sha256) == brute_conversation([x[2:] for x in sorted(v)])
    assert chat_format.format_conversations(df.limit(0), BYTE_BPE).count() == 0
    tokenizer = chat_format.chat_tokenizer(BYTE_BPE)
    for r in formatted.filter("conv_id < 5").collect():
        assert len(r.ids) == len(r.offsets) == len(r.loss_mask) and list(tokenizer.encode(r.formatted, add_special_tokens=False).ids) == list(r.ids)


# ---- classifier


def test_forward_backward_is_exact():
    rng = np.random.default_rng(3)
    row = np.repeat([0, 1, 2], [1, 4, 3])
    e, t = rng.normal(size=8), rng.normal(size=(2, 2))
    ahead, behind = quality_crf.forward_backward(e, quality_crf.Chains(row), t)
    for r in range(3):
        at = np.flatnonzero(row == r)
        total, good = 0.0, np.zeros(len(at))
        for k in range(2 ** len(at)):
            y = [(k >> i) & 1 for i in range(len(at))]
            w = np.exp(sum(e[at[i]] * y[i] for i in range(len(at))) + sum(t[y[i], y[i + 1]] for i in range(len(at) - 1)))
            total += w
            good += w * np.array(y)
        assert np.allclose(1 / (1 + np.exp(-(ahead + behind)[at])), good / total)


def test_classifier_on_held_out_rows(spark, sf):
    folder = sf.replace("0.001", "0.01")
    out = {r.doc_id: r for r in queries.op4_quality_crf(spark, folder).collect()}
    labels = spark.read.parquet(f"{folder}/labels.parquet").collect()
    assert all(r.held_out == (zlib.crc32(str(k).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for k, r in out.items())
    held = [(out[x.doc_id], x.quality) for x in labels if out[x.doc_id].held_out]
    good, bad = ([r for r, q in held if q == v] for v in (1, 0))
    assert sum(r.predicted for r in good) / len(good) > 0.98
    assert sum(not r.predicted for r in bad) / len(bad) > 0.8
    assert np.mean([g.score > b.score for g in good for b in bad]) > 0.97


def mixed_documents(rng, n):
    """(text, label, the lines' labels): good documents, and bad ones of which some lines are good."""
    words = ["river", "house", "over", "small", "green", "about", "never", "walked", "under", "stone"]
    line = lambda: " ".join(rng.choice(words, 12)) + "."
    junk = lambda: " | ".join(rng.choice(words, 9)) + " $$$ ###"
    out = []
    for k in range(n):
        if k % 2:
            out.append(("\n".join(line() for _ in range(8)), 1, [1] * 8))
        else:
            at = int(rng.integers(1, 4))
            out.append(("\n".join([line() for _ in range(at)] + [junk() for _ in range(8 - at)]), 0, [1] * at + [0] * (8 - at)))
    return out


def test_planted_bad_lines_are_found():
    train, check = (mixed_documents(np.random.default_rng(s), n) for s, n in ((1, 200), (2, 40)))

    def arrays(docs_):
        parts = [quality_crf.line_features(data, bounds) for _, _, data, bounds in text_arrays.text_slices(pa.array([t for t, _, _ in docs_]))]
        assert len(parts) == 1
        return parts[0][0].astype(float), parts[0][1]

    x, row = arrays(train)
    good = np.array([y for _, y, _ in train])
    labels = quality_crf.line_labels(x, row, good)
    assert labels.tolist() == [y for _, _, lines in train for y in lines]
    field = quality_crf.Field(*quality_crf.train(x, row, labels))
    x, row = arrays(check)
    p = field.marginals(x, row)
    assert ((p >= 0.5).astype(int) == [y for _, _, lines in check for y in lines]).all()
    bad = [p[row == k] for k, (_, y, _) in enumerate(check) if not y]
    assert min(v.max() - v.min() for v in bad) > 0.5  # lines of one document differ
    assert field.transitions[0, 0] + field.transitions[1, 1] > field.transitions[0, 1] + field.transitions[1, 0]


def brute_score(text, field):
    """A document's score by summing over all labellings of its lines."""
    x, _, n = quality_crf.line_features(*next((d, b) for _, _, d, b in text_arrays.text_slices(pa.array([text]))))
    if not len(x):
        return 0.0
    e, good, total = x.astype(float) @ field.weights, np.zeros(len(x)), 0.0
    for k in range(2 ** len(x)):
        y = np.array([(k >> i) & 1 for i in range(len(x))])
        w = np.exp(e @ y + sum(field.transitions[a, b] for a, b in zip(y, y[1:], strict=False)))
        total, good = total + w, good + w * y
    mean = np.clip((good / total) @ n / n.sum(), 1e-6, 1 - 1e-6)
    return 1 / (1 + np.exp(-(field.scale * np.log(mean / (1 - mean)) + field.shift)))


def test_scores_of_the_query_against_all_labellings(spark, sf):
    d, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    field = quality_crf.fit(quality_crf.training_rows(d, labels))
    out = {r.doc_id: r.score for r in queries.op4_quality_crf(spark, sf).collect()}
    texts = [(r.doc_id, r.text) for r in d.collect()]
    short = [(i, t) for i, t in texts if sum(bool(x.strip()) for x in (t or "").split("\n")) <= 10]
    assert len(out) == len(texts) and len(short) > 50
    assert np.allclose([out[i] for i, _ in short], [brute_score(t or "", field) for _, t in short], atol=1e-6)


def test_classifier_edges(spark):
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(40)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    rows = [(k, "A fine line of plain words.\nAnd one more line." if k % 2 else "BUY!! NOW!! $$$ ### ***\n" * 3, None) for k in range(40)]
    df = docs(spark, rows).withColumn("score", F.lit("clash"))
    model = quality_crf.fit(quality_crf.training_rows(df, labels))
    odd = quality_crf.score_documents(docs(spark, ODD), model).collect()
    assert len(odd) == len(ODD) and all(0 <= r.score <= 1 for r in odd)
    assert {r.score for r in odd if r.doc_id in (1, 2, 3)} == {0.0}
    assert quality_crf.score_documents(docs(spark, []), model).count() == 0
    kept = quality_crf.rows_of_quality(df, labels)
    assert kept.columns == df.columns and {r.doc_id % 2 for r in kept.collect()} == {1}
    assert quality_crf.score_documents(df, quality_crf.fit(quality_crf.training_rows(df, labels.limit(0)))).select("score").distinct().collect()[0][0] == 0.5


# ---- Jaccard join


def shingles(text, words):
    w = WORD.findall((text or "").translate(LOW))
    return frozenset([tuple(w)] if 0 < len(w) < words else [tuple(w[k : k + words]) for k in range(len(w) - words + 1)])


def brute_components(rows, words, percent):
    sets = [shingles(t, words) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if n and 100 * n >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows))


def near_copies(seed, bases=6, copies=25, edits=8, length=120):
    rnd = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(300)]
    passage = " ".join(rnd.choices(vocabulary, k=25))
    out = []
    for _ in range(bases):
        base = rnd.choices(vocabulary, k=rnd.randrange(3, length))
        for _ in range(copies):
            w = list(base)
            for _ in range(rnd.randrange(edits)):
                at = rnd.randrange(len(w))
                w[at : at + 1] = rnd.choice(([], ["New"], [w[at].upper()], [w[at], "x"]))
                w = w or ["a"]
            out.append(" ".join(w))
    out += [f"{passage} {' '.join(rnd.choices(vocabulary, k=40))}" for _ in range(40)]
    rnd.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize(("words", "percent", "seed"), [(4, 85, 1), (5, 80, 2), (2, 60, 3)])
def test_components_against_all_pairs(spark, monkeypatch, words, percent, seed):
    rows = near_copies(seed) + [(1000, None), (1001, ""), (1002, " \n"), (1003, "a"), (1004, "A"), (1005, "a b")]
    monkeypatch.setattr(jaccard_join, "PART", 4)  # so that groups, those that ask and long rows are split
    monkeypatch.setattr(jaccard_join, "ASKING", 4)
    monkeypatch.setattr(jaccard_join, "FREQUENT", 5)
    monkeypatch.setattr(jaccard_join, "LONG_ROW", 8)
    df = docs(spark, [(i, t, "s") for i, t in rows]).repartition(3)
    out = jaccard_join.jaccard_components(df, words, percent).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in out) == brute_components(rows, words, percent)


def test_join_edges(spark):
    out = jaccard_join.jaccard_components(docs(spark, ODD), 4, 85).collect()
    assert len(out) == len(ODD)
    assert {r.component_id for r in out if r.doc_id in (4, 7)} == {4}
    assert jaccard_join.jaccard_components(docs(spark, []), 4, 85).count() == 0
    df = docs(spark, ODD).withColumn("cls", F.lit(1)).withColumn("row", F.lit("clash"))
    kept = jaccard_join.one_of_each(df)
    assert kept.columns == df.columns
    assert Counter(r.text for r in kept.collect())["one two"] == 1 and kept.count() == 6


def test_near_copies_of_texts_without_a_doc_id(spark):
    words = [f"w{k}" for k in range(60)]
    text, near, far = " ".join(words), " ".join(words[:-2]), " ".join(f"v{k}" for k in range(60))
    rows = [(None, text, "s"), (5, text, "s"), (6, near, "s"), (None, far, "s"), (None, far, "s"), (7, far + " x", "s"), (None, "alone", "s")]
    out = jaccard_join.jaccard_components(docs(spark, rows).coalesce(1), 4, 85).collect()
    found = Counter((r.doc_id, r.n_shingles, r.component_id) for r in out)
    assert found == Counter([(None, 57, 5), (5, 57, 5), (6, 55, 5), (None, 57, 7), (None, 57, 7), (7, 58, 7), (None, 1, None)])


@pytest.mark.parametrize(("n", "m"), [(1, 1), (5, 6), (120, 135), (250, 262), (1020, 1030), (300, 3000)])
def test_bits_never_miss_more_than_the_sets(spark, n, m):
    tokens = np.unique(np.random.default_rng(n).integers(0, 1 << 62, 2 * m, dtype=np.uint64))
    a, b = tokens[:n], tokens[n // 4 : n // 4 + m]
    bits = [jaccard_join.token_bits(x).tolist() for x in (a, b)]
    row = spark.createDataFrame([(*bits,)], "a array<long>, b array<long>")
    there, back, none = row.select(*[jaccard_join.missing_at_least(F.col(x), F.col(y)) for x, y in ("ab", "ba", "aa")]).first()
    assert there <= len(np.setdiff1d(a, b)) and back <= len(np.setdiff1d(b, a)) and none == 0
    assert n < 100 or m > 2 * n or there > 0.2 * len(np.setdiff1d(a, b))  # few places are free in a much larger set


def test_group_unions_hold_all_bits(spark):
    rng = np.random.default_rng(7)
    sets = [np.unique(rng.integers(0, 1 << 62, k, dtype=np.uint64)) for k in (30, 40, 100, 500, 20)]
    light = spark.createDataFrame([(k, len(x), jaccard_join.token_bits(x).tolist()) for k, x in enumerate(sets)], "row long, n int, bits array<long>")
    members = spark.createDataFrame([(0, 0), (0, 1), (0, 2), (3, 3), (3, 4)], "grp long, row long")
    out = {r.grp: r for r in jaccard_join.group_unions(members, light, common.Scratch(spark)).collect()}
    assert [(out[g].members, out[g].n_min, out[g].n_max) for g in (0, 3)] == [(3, 30, 100), (2, 20, 500)]
    for g, rows in ((0, (0, 1, 2)), (3, (3, 4))):
        held = np.array(out[g].bits, np.int64).view(np.uint64)
        for k in rows:
            at = (text_arrays.mix(sets[k]) & np.uint64(64 * len(held) - 1)).astype(np.int64)
            assert all(int(held[x >> 6]) >> (x & 63) & 1 for x in at.tolist())


@pytest.mark.parametrize(("n", "m"), [(120, 135), (250, 262), (1020, 1030)])
def test_sets_of_unlike_sizes_link(spark, n, m):
    words = [f"w{k}" for k in range(m + 3)]  # shingles of four words
    rows = [(5, " ".join(words[: n + 3])), (6, " ".join(words)), (7, "another text of its own")]
    out = jaccard_join.jaccard_components(docs(spark, [(i, t, "s") for i, t in rows]), 4, 85).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in out) == brute_components(rows, 4, 85) == [(5, n, 5), (6, m, 5), (7, 2, 7)]


def test_join_query_against_all_pairs(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    out = queries.op5_jaccard_join(spark, sf).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in out) == brute_components(rows, 4, 85)


def test_connected_components(spark):
    rnd = random.Random(4)
    edges = [(rnd.randrange(200), rnd.randrange(200)) for _ in range(150)] + [(k, k + 1) for k in range(300, 340)] + [(5, 5)]
    parent = {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    out = components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert {r.node: r.label for r in out} == {x: find(x) for x in parent if any(x in e and e[0] != e[1] for e in edges)}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


# ---- packing


def test_word_encoder_gives_the_librarys_ids():
    tokenizer = Tokenizer.from_file(WORD_BPE)
    texts = fuzz(1500)
    encoder = packing.WordEncoder(WORD_BPE, remembered=50)
    for k in range(0, len(texts), 100):
        part = texts[k : k + 100]
        assert encoder.encode(part) == [np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in part]


def check_packed(rows, size=2048):
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for v in bins.values():
        at = 0
        for offset, length in sorted(v):
            assert offset == at
            at += length
        assert at <= size
    return len(bins)


def test_packing_query(spark, sf):
    tokenizer = Tokenizer.from_file(WORD_BPE)
    want = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = np.array([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
        for k in range(0, len(ids), 2048):
            want[(r.doc_id, k // 2048)] = (k, len(ids[k : k + 2048]), zlib.crc32(ids[k : k + 2048].tobytes()))
    rows = queries.op8_packing(spark, sf).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want and len(rows) == len(want)
    assert check_packed(rows) <= -(-sum(x[1] for x in want.values()) // 2048) + 2


def test_packing_edges(spark):
    rows = packing.pack_documents(docs(spark, ODD), WORD_BPE, size=64, with_ids=True).collect()
    assert all(len(r.ids) == 4 * r.length and zlib.crc32(bytes(r.ids)) == r.ids_crc32 for r in rows)
    check_packed(rows, 64)
    assert Counter(r.doc_id for r in rows)[4] == 2
    assert packing.pack_documents(docs(spark, []), WORD_BPE).count() == 0


def test_other_tokenizers_encode_whole_texts():
    assert packing.word_by_word(WORD_BPE) and not packing.word_by_word(BYTE_BPE)
    tokenizer = Tokenizer.from_file(BYTE_BPE)
    texts = fuzz(100, seed=6)
    want = [np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert packing.WordEncoder(BYTE_BPE).encode(texts) == want


def fills(packed, lengths):
    fill = Counter()
    for b, n in zip(packed, lengths, strict=True):
        fill[b] += n
    return fill


@pytest.mark.parametrize("seed", range(4))
def test_local_search_saves_bins(seed):
    rnd = random.Random(seed)
    lengths = [rnd.choice((700, 690, 650, 660, 680, 340, 1000, 1040)) + rnd.randrange(20) for _ in range(600)]
    plain = fills(packing.Bins(lengths, 2048).home, lengths)
    fill = fills(packing.pack_lengths(lengths, 2048), lengths)
    assert max(fill.values()) <= 2048 and len(fill) < 0.95 * len(plain)
    assert packing.pack_lengths([], 2048) == []


def test_search_earns_the_bins_of_the_test_table(spark, sf):
    rows = queries.op8_packing(spark, sf.replace("0.001", "0.01")).collect()
    lengths = [r.length for r in rows if r.length < 2048]
    bins = packing.Bins(lengths, 2048)
    plain = len(bins.items)
    bins.improve()
    least = -(-sum(lengths) // 2048)
    assert len(set(bins.home)) <= least + 1 < plain and bins.steps["move"] > 0 and bins.steps["one for one"] > 0
    assert check_packed(rows) <= -(-sum(r.length for r in rows) // 2048) + 1


def test_each_step_raises_the_sum_of_squares():
    rnd, kinds = random.Random(9), Counter()
    for _ in range(30):
        bins = packing.Bins([rnd.choice((31, 33, 47, 52, 66)) for _ in range(60)], 100)
        while bins.open:
            b = bins.take_fullest()
            while bins.fill[b] < 100:
                before = sum(f * f for f in bins.fill)
                gain, out, into = bins.best_step(b)
                if not gain:
                    break
                kinds[len(out), len(into)] += 1
                bins.exchange(b, out, into)
                assert sum(f * f for f in bins.fill) > before and max(bins.fill) <= 100
        for b, items in enumerate(bins.items):
            assert sum(x[0] for x in items) == bins.fill[b] and all(bins.home[i] == b for _, i in items)
    assert set(kinds) == {(0, 1), (1, 1), (1, 2)}


# ---- token counts


@pytest.mark.parametrize("path", [BYTE_BPE, PIECES])
def test_resynchronised_counts(path):
    encode, count, proven = token_counts.load_tokenizer(path)
    assert proven
    texts = [x for x in fuzz(60, 900, seed=2) if path == BYTE_BPE or "<|" not in x] + ["word " * 700, "x" * 3000, "日本語" * 900, "the end. " * 300, "a b" * 500 + "1" * 900 + " c d" * 400]
    for t, want in zip(texts, count(texts), strict=True):
        for chunk, overlap in ((200, 16), (500, 64), (64, 8)):
            assert token_counts.count_resynchronised(t, encode, chunk, overlap) == want
        places = token_counts.chunk_places(len(t), 100, 16)
        assert not t or token_counts.count_huge(t, places, encode, 16, run=3) == want


def test_tokenizers_that_cross_spaces_are_told():
    assert token_counts.spaced(BYTE_BPE) and token_counts.spaced(PIECES) and not token_counts.spaced(WORD_BPE)


def test_token_counts_of_another_tokenizer_are_whole(spark):
    tokenizer = Tokenizer.from_file(WORD_BPE)
    for r in token_counts.token_counts(docs(spark, ODD), WORD_BPE, chunk=100, overlap=10).collect():
        assert r.n_chunks <= 1
    texts = fuzz(30, 400, seed=8)
    out = {r.doc_id: r.n_tokens for r in token_counts.token_counts(docs(spark, list(zip(range(30), texts, "s" * 30, strict=True))), WORD_BPE).collect()}
    assert out == {k: len(tokenizer.encode(t, add_special_tokens=False).ids) for k, t in enumerate(texts)}


def test_token_count_query_and_edges(spark, sf):
    tokenizer = Tokenizer.from_file(BYTE_BPE)
    text = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op9_token_counts(spark, sf).collect()
    for r in rows:
        n = len(tokenizer.encode(text[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text[r.doc_id].encode()), n, n > 512)
    assert sum(r.n_chunks > 1 for r in rows) > len(rows) // 4  # ordinary documents are spliced
    clash = docs(spark, ODD).withColumn("n_tokens", F.lit("clash")).withColumn("n_bytes", F.lit(None))
    out = token_counts.token_counts(clash, BYTE_BPE, chunk=1000, overlap=50).collect()
    assert len(out) == len(ODD) and {r.n_tokens for r in out if r.doc_id in (1, 2)} == {0}
    assert next(r.n_tokens for r in out if r.doc_id == 5) == len(tokenizer.encode("x " * 30000).ids)
    assert token_counts.token_counts(docs(spark, []), BYTE_BPE).count() == 0


assert DOCS
