"""Edge cases of the corpus operators: colliding words, repeated and null doc_ids, hot groups cut into blocks."""

import base64
import hashlib
import html
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from filigree.llm import bpe, common, decontaminate, fingerprints, jaccard_join, kd_sharding, pii, quality, run_index, token_orc, wrappers
from filigree.llm.textarrays import word_hashes

P = pytest.importorskip("public_tokenizers")
TWO = "doc_id long, text string"
THUE = "a"
for _ in range(10):
    THUE += THUE.translate(str.maketrans("ab", "ba"))
MORSE = THUE.translate(str.maketrans("ab", "ba"))


def shingle_set(text, width=5):
    own = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(own[k : k + width]) for k in range(len(own) - width + 1)} if len(own) >= width else {tuple(own)} if own else set()


def brute_hits(text, windows, width=10):
    own = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return any(tuple(own[a : a + n]) in windows for n in range(1, width + 1) for a in range(len(own) - n + 1))


def brute_windows(texts, width=10):
    out = set()
    for t in texts:
        own = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out |= {tuple(own[a : a + width]) for a in range(max(1, len(own) - width + 1))} if own else set()
    return out


def brute_components(texts):
    sets = [shingle_set(t) for t in texts]
    comp = list(range(len(texts)))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and comp[i] > comp[j] and 100 * len(a & b) >= 80 * len(a | b):
                    comp[i], changed = comp[j], True
    return comp


def test_words_of_equal_structure_differ(spark):
    from tokenizers import Tokenizer

    data = np.frombuffer((THUE + MORSE).encode(), np.uint8)
    a, b = word_hashes(data, np.array([0, 1024]), np.array([1024, 2048]))
    assert a != b
    texts = [f"{THUE} one", f"{MORSE} one", f"{MORSE} {THUE} x {THUE}"]
    docs = spark.createDataFrame(list(enumerate(texts)), TWO)
    exact, path = Tokenizer.from_file(P.path("word_bpe_49k.json")), common.new_path(spark, "test")
    token_orc.write(docs, path, P.path("word_bpe_49k.json"), 1, 1)
    for r in token_orc.checksums(token_orc.read(spark, path)).collect():
        ids = np.array([*exact.encode(texts[r.doc_id], add_special_tokens=False).ids, 1], "<u4")
        assert (r.n_tokens, r.ids_crc32) == (len(ids), zlib.crc32(ids.tobytes()))
    assert {r.doc_id: r.component_id for r in jaccard_join.components_of(docs).collect()} == {0: 0, 1: 1, 2: 2}
    assert len({s for s in fingerprints.signatures(pa.array(texts))}) == 3
    assert len(quality.statistics(data, np.array([0, 1024, 2048]))) == 2


def test_a_word_that_shares_anothers_hash_is_encoded_by_itself(monkeypatch):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    whole = token_orc.word_hashes
    monkeypatch.setattr(token_orc, "word_hashes", lambda data, starts, ends: np.where(ends - starts > 8, np.uint64(77), whole(data, starts, ends)))
    own, exact = token_orc.WordEncoder(path, 1), Tokenizer.from_file(path)
    for text in ("encyclopedia words of considerable length", "considerable letters, encyclopedia and encyclopaedias considerable"):
        data = np.frombuffer(text.encode(), np.uint8)
        ids, _ = own.encode(data, np.array([0, len(data)]))
        assert ids.tolist() == [*exact.encode(text, add_special_tokens=False).ids, 1]


def test_hot_group_in_blocks(spark, monkeypatch):
    """Near copies that link in chains, in buckets of many blocks; texts that share a bucket and nothing else stay apart."""
    monkeypatch.setattr(jaccard_join, "BLOCK_ROWS", 7)
    rng = np.random.default_rng(11)
    base, texts = [f"w{k}" for k in range(120)], []
    for _ in range(60):
        own = list(base)
        for k in rng.choice(120, int(rng.integers(0, 4)), replace=False):
            own[k] = f"z{rng.integers(9)}"
        texts.append(" ".join(own))
    for k in range(40):
        texts.append(" ".join([*base[:20], *(f"v{k}x{j}" for j in range(int(rng.integers(4, 40))))]))
    texts += texts[:9]
    order = rng.permutation(len(texts))
    texts = [texts[k] for k in order]
    docs = spark.createDataFrame(list(enumerate(texts)), TWO).repartition(3)
    want = brute_components(texts)
    for found in (jaccard_join.components_of(docs), fingerprints.near_copies(docs)):
        got = {r.doc_id: r.component_id for r in found.collect()}
        assert [got[k] for k in range(len(texts))] == want and 3 < len(set(want)) < 90


def test_links_come_out_once_for_each_joined_component():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 100).astype(np.uint64)
    sets = [np.unique(np.concatenate([base[: 100 - k % 9], rng.integers(0, 2**63, k % 5).astype(np.uint64)])) for k in range(50)]
    at = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    ids = np.arange(50)
    i, j = jaccard_join.join_rows(ids, np.diff(at), ids, [jaccard_join.bitmap(s) for s in sets], np.zeros(50, int))
    assert len(jaccard_join.spanning(ids, ids, i, j, np.concatenate(sets), at)) == 49


def test_joins_of_repeated_and_null_doc_ids(spark):
    long = " ".join(f"w{k}" for k in range(200))
    near, other = long + " end", " ".join(f"v{k}" for k in range(50))
    rows = [(3, long), (3, long), (5, near), (7, other), (7, long.upper()), (None, near), (None, "alone of its kind here"), (9, other + " z")]
    got = sorted(((r.doc_id, r.component_id) for r in jaccard_join.components_of(spark.createDataFrame(rows, TWO)).collect()), key=str)
    assert got == sorted([(3, 3), (3, 3), (5, 3), (7, 3), (7, 3), (None, 3), (None, None), (9, 3)], key=str)
    clash = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], TWO + ", comp int, rep int, _gone string")
    kept = jaccard_join.one_of_each(clash)
    assert kept.columns == clash.columns and kept.count() == 4


def _texts_of(spark, pages, host="h.example"):
    table = spark.createDataFrame([(k, f"http://{host}/{k}", x, "clash", 1) for k, x in enumerate(pages)], "page_id long, url string, html string, host string, wrapper int")
    return [r.text for r in wrappers.main_text(table).orderBy("page_id").collect()]


def test_articles_of_all_pages(spark):
    """Every page of the table against a plain reading of its only article."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r.text for r in wrappers.main_text(pages).collect()}
    checked = 0
    for r in pages.collect():
        inner = re.findall(r"<article\b[^>]*>(.*?)</article>", r.html or "", re.S)
        if len(inner) != 1 or re.search(r"<(?!/?(?:p|b|i|a|br|h1|h2|em|li|ul|strong|blockquote|table|tr|td)\b)[a-z]", inner[0]):
            continue
        blocks = re.split(r"</?(?:p|h1|h2|li|ul|blockquote|table|tr|td)\b[^>]*>", re.sub(r"<!--.*?-->", "", inner[0], flags=re.S))
        plain = (" ".join(html.unescape(re.sub(r"</?[a-z][^>]*>", "", re.sub(r"<br\b[^>]*>", " ", b))).split()) for b in blocks)
        assert got[r.page_id] == "\n".join(b for b in plain if b), r.page_id
        checked += 1
    assert checked > 150


def test_the_wrapper_decides(spark):
    """Hosts without article and with meaningless names: only the alignment of the pages tells what is template."""
    notice = "We have updated the terms under which these pages may be read by everyone. " * 3
    page = "<body><div class='k1'><p>Northern Weekly</p></div><div class='k2'><h2>Title {0}</h2><p>First {0} it says</p><p>{1}</p></div><div class='k3'><p>" + notice + "</p></div></body>"
    pages = [page.format(f"number{min(k, 7)}", f"Second {min(k, 7)} it says. " * 20) for k in range(11)]
    want = [f"Title number{k}\nFirst number{k} it says\n" + (f"Second {k} it says. " * 20).strip() for k in (*range(8), 7, 7, 7)]
    assert _texts_of(spark, pages) == want
    page = wrappers.parse(pages[0])
    off = wrappers.extract(page, wrappers.wrapper_of(page), "", set())
    assert "Northern Weekly" in off and notice.strip() in off


def test_markup_that_ends_at_the_bracket(spark):
    page = "<body><article><p don't>One</p><p title=it's>Two</p><p x = 'a > b'>Three</p><![CDATA[ hidden ]]><p>Four</p><? php ?><p a==\"b>c\">Five</p></article>"
    assert _texts_of(spark, [page, None, ""]) == ["One\nTwo\nThree\nFour\nFive", "", ""]


def test_a_heterogeneous_host_has_a_bounded_wrapper(monkeypatch):
    monkeypatch.setattr(wrappers, "MOST_TOKENS", 60)
    total = wrappers.Wrapper()
    for k in range(300):
        total.fold(wrappers.wrapper_of(wrappers.parse(f"<body><div><p>The frame</p></div><div class='{'xyzuvw'[k % 6] * (k % 7 + 1)}{chr(97 + k % 26)}'><p>Text {k} is longer</p><ul><li>{k}</ul></div>")))
    assert len(total.tokens) < 90 and total.pages == 300
    assert [total.tokens[k] for k in total.template()] == ["#p"]


def test_pages_empty_and_without_ids(spark):
    kind = "page_id long, url string, html string"
    assert wrappers.main_text(spark.createDataFrame([], kind)).count() == 0
    rows = [(None, None, "<article>a</article>"), (None, None, "<article>a</article>"), (1, "http://x/1", "<article>b</article>"), (1, "http://x/1", "<article>b</article>")]
    assert sorted(r.text for r in wrappers.main_text(spark.createDataFrame(rows, kind)).collect()) == ["a", "a", "b", "b"]


@pytest.mark.parametrize("block_words", [2_000_000, 12])
def test_items_and_rows_without_ids(spark, monkeypatch, block_words):
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", block_words)
    texts = ["a b c d", "x y z", "a b c d", None, "c d e and nothing"]
    docs = spark.createDataFrame([(k, t, 1, "x") for k, t in zip([1, None, 1, None, 1], texts, strict=True)], TWO + ", matches int, n_words string")
    items = spark.createDataFrame([(None, "b c"), (None, "y z"), (3, "d e"), (3, "d e"), (4, None), (5, "one two three four five six seven eight nine ten eleven")], "item_id long, text string")
    got = decontaminate.matches(docs, items).collect()
    found = sorted(((r.doc_id, r.n_words, sorted((m.item_id, m.start, m.end) for m in r.matches) if len(r.matches) < 2 else len(r.matches)) for r in got), key=str)
    assert found == sorted([(1, 4, [(None, 1, 3)]), (None, 3, [(None, 1, 3)]), (1, 4, [(None, 1, 3)]), (None, 0, []), (1, 5, 2)], key=str)
    kept = decontaminate.decontaminate(docs, items)
    assert kept.columns == docs.columns and [r.text for r in kept.collect()] == [None]
    assert decontaminate.matches(docs.limit(0), items).count() == 0


def test_context_on_both_sides(spark):
    def kinds(text):
        return [(s.kind, text[s.start : s.end]) for s in spark.createDataFrame([(1, text)], TWO).select(pii.find(F.col("text")).alias("s")).first().s]

    assert kinds("555-123-4567 is my phone") == [("local_phone", "555-123-4567")]
    assert len(kinds("call phone 555-123-4567, 555-123-4568, 555-123-4569")) == 3
    assert kinds("555-123-4567 " + "x" * 60 + " phone") == []


def test_many_spans_and_clashing_names(spark):
    n = 1500
    text = " ".join(f"a{k}@b.co {k % 250}.1.2.3x" for k in range(n)) + " end a@b.c.d@e.f"
    rows = [(None, text, 7, "s", "x"), (1, None, 0, "s", "x"), (1, "", 0, "s", "x"), (1, "mail a@b.c", 0, "s", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, _spans string, spans string")
    got = pii.redact(docs)
    assert got.columns == docs.columns
    out = {r.text for r in got.collect()}
    want = re.sub(r"\[EMAIL\]@\[EMAIL\]", "[EMAIL]", re.sub(r"[0-9]+\.1\.2\.3", "[IP]", re.sub(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "[EMAIL]", text)))
    assert out == {want, None, "", "mail [EMAIL]"}
    found = pii.scan(docs).collect()
    assert max(len(r.spans) for r in found) == 2 * n + 1 and len(found) == 4
    assert pii.scan(docs.limit(0)).count() == 0


def brute_shards(rows, shards):
    """The k-d tree by sorting: rows are (size, source, lang, doc_id), and the result is their shard."""
    out, span = [0] * len(rows), None

    def split(own, n, first):
        nonlocal span
        if n == 1 or not own:
            for k in own:
                out[k] = first
            return
        low, high = ([f(rows[k][d] for k in own) for d in range(4)] for f in (min, max))
        span = span or [max(1, b - a) for a, b in zip(low, high, strict=True)]
        d = max(range(4), key=lambda i: (high[i] - low[i]) / span[i])
        order = sorted(own, key=lambda k: (rows[k][d], rows[k][3]))
        wanted, total = sum(rows[k][0] for k in own) * (n // 2) / n, 0
        cuts = [(0, 0)]
        for i, k in enumerate(order):
            total += rows[k][0]
            if i + 1 == len(order) or (rows[k][d], rows[k][3]) != (rows[order[i + 1]][d], rows[order[i + 1]][3]):
                cuts.append((i + 1, total))
        j = next(j for j in range(1, len(cuts)) if cuts[j][1] >= wanted or j == len(cuts) - 1)
        at = cuts[j][0] if abs(cuts[j][1] - wanted) <= abs(cuts[j - 1][1] - wanted) else cuts[j - 1][0]
        split(order[:at], n // 2, first)
        split(order[at:], n - n // 2, first + n // 2)

    split(list(range(len(rows))), shards, 0)
    return out


@pytest.mark.parametrize("shards", [1, 3, 8, 37])
def test_sharding_against_sorting(spark, monkeypatch, shards):
    monkeypatch.setattr(kd_sharding, "BINS", 7)
    monkeypatch.setattr(kd_sharding, "LEAST_BINS", 2)
    monkeypatch.setattr(kd_sharding, "MOST_BINS", 40)
    rng = np.random.default_rng(6)
    texts = ["x" * int(n) for n in rng.integers(0, 60, 200)] + ["é" * 9000, "", None]
    rows = [(int(k) * 10**12 - 7, t, "hot" if k % 3 else f"s{k % 5}", None if k % 11 == 0 else "en", 5, k) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, node int, shard int").repartition(4)
    crc = lambda x: -1 if x is None else zlib.crc32(x.encode())
    want = brute_shards([(len((r[1] or "").encode()) + 1, crc(r[2]), crc(r[3]), r[0]) for r in rows], shards)
    got = {r.doc_id: r for r in kd_sharding.assign(docs, shards).collect()}
    assert [got[r[0]].shard for r in rows] == want
    assert all((got[r[0]].size, got[r[0]].text_crc32) == (len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows)
    for s in set(want):
        assert [r.slot for r in sorted((r for r in got.values() if r.shard == s), key=lambda r: r.doc_id)] == list(range(want.count(s)))


def test_sharding_to_a_size_with_repeats(spark):
    rows = [(None, "a" * 50), (None, "a" * 50), (4, "b" * 99), (4, "b" * 99), *((k, "c" * 20) for k in range(10, 60))]
    got = kd_sharding.assign(spark.createDataFrame(rows, TWO), target_bytes=300).toPandas()
    assert len(got) == len(rows) and got.shard.nunique() == -(-(2 * 51 + 200 + 50 * 21) // 300)
    assert got[got.doc_id == 4].shard.nunique() == 1 and got.doc_id.isna().sum() == 2 and not (got.doc_id == -1).any()


def brute_signature(text):
    """Minima over Python's whole numbers of the universal hashes of a text's shingles."""
    found = [int(x) for x in fingerprints.shingle_sets(np.frombuffer((text or "").encode(), np.uint8), np.array([0, len((text or "").encode())]))[0]]
    pairs = zip(map(int, fingerprints._A), map(int, fingerprints._B), strict=True)
    return [(min((x * a + b) % 2**64 for x in found) >> 20) % 2**16 if found else 2**16 - 1 for a, b in pairs]


@pytest.mark.parametrize("part_bytes", [1, 700, 1 << 24])
def test_fingerprints_against_brute_force(spark, part_bytes):
    rng = np.random.default_rng(9)
    words = [f"w{k}" for k in range(50)]
    texts = [" ".join(rng.choice(words, int(n))) for n in rng.integers(0, 60, 40)] + [None, "", "é🙂 a b c d e f", "x" * 4000]
    ids = [int(k) for k in rng.permutation(len(texts))]
    rows = [(i, t, "x", 1) for i, t in zip(ids, texts, strict=True)] + [(None, "null id one two three four", "x", 2), (3, texts[ids.index(3)], "x", 3)]
    docs = spark.createDataFrame(rows, TWO + ", fingerprint string, part int").repartition(5)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want = []
    for k, (i, t, *_) in enumerate(order):
        own, following = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(own) // 2
        edited = own[: len(own) - half] + following[:half]
        p, q, r = (brute_signature(x) for x in (own, edited, following))
        like = [sum(a == b for a, b in zip(p, z, strict=True)) / 128 for z in (q, r)]
        want.append((i, len(own), hashlib.sha256(edited.encode()).hexdigest(), "".join(f"{x:04x}" for x in p), "".join(f"{x:04x}" for x in q), *like))
    got = [tuple(r) for r in fingerprints.compare_edited(docs, part_bytes).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_fingerprints_estimate_the_similarity():
    rng = np.random.default_rng(1)
    errors = []
    for _ in range(40):
        both, one, two = (rng.integers(0, 2**63, n).astype(np.uint64) for n in (int(rng.integers(50, 300)), 40, 60))
        a, b = np.concatenate([both, one]), np.concatenate([both, two])
        errors.append(fingerprints.likeness(fingerprints.signature(a).astype(">u2").tobytes(), fingerprints.signature(b).astype(">u2").tobytes()) - len(both) / (len(both) + 100))
    assert abs(np.mean(errors)) < 0.02 and np.abs(errors).max() < 0.16


def brute_removed(texts):
    """Sizes and hashes of what is left of texts in their order."""
    seen, out = set(), []
    for t in texts:
        own = (t or "").encode()
        gone = np.zeros(len(own), bool)
        for k in range(len(own) - 99):
            if own[k : k + 100] in seen:
                gone[k : k + 100] = True
            seen.add(own[k : k + 100])
        out.append((len(own), int(gone.sum()), hashlib.sha256(np.frombuffer(own, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


def test_hot_passage_in_many_contexts(spark, monkeypatch):
    monkeypatch.setattr(run_index, "HOT_SEGMENTS", 8)
    rng = np.random.default_rng(3)
    passage = "".join(rng.choice(list("abcdefgh "), 130))
    letters = np.array(list("klmnopqrst "))
    texts = ["".join(rng.choice(letters, 150)) + passage[: 130 - k % 9] + "".join(rng.choice(letters, 150)) for k in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), TWO).repartition(4)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.kept_sha256) for r in run_index.without_repeats(docs).collect()}
    assert [got[k] for k in range(60)] == brute_removed(texts)
    assert sum(x[1] for x in got.values()) > 59 * 100


def test_repeats_of_repeated_and_null_doc_ids(spark):
    rng = np.random.default_rng(8)
    a, b, c = ("".join(rng.choice(list("abcdefgh "), 300)) for _ in range(3))
    rows = [(5, a), (5, a), (5, b + a), (None, c), (None, c), (None, a + c), (7, b), (2, "x" + a), (9, None), (9, "")]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], TWO + ", anchor int, marks string")
    distinct = sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0, hashlib.sha256((r[1] or "").encode()).hexdigest()))
    results = dict(zip(distinct, brute_removed([r[1] for r in distinct]), strict=True))
    want = sorted((r[0], *results[r]) for r in rows if r[0] is not None) + sorted(results[r] for r in rows if r[0] is None)
    got = run_index.without_repeats(docs).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.kept_sha256) for r in got if r.doc_id is not None) + sorted((r.n_bytes, r.n_removed, r.kept_sha256) for r in got if r.doc_id is None) == want
    assert run_index.without_repeats(docs.limit(0)).count() == 0


def _read_rows(df):
    """Rows that the scan of a plan without exchanges has put out."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().collectLeaves().head().metrics().apply("numOutputRows").value()


def test_token_files_are_pruned(spark):
    docs = spark.range(0, 12000, 2).selectExpr("id AS doc_id", "concat('w', id) AS text", "'x' AS ids", "1 AS part")
    path = common.new_path(spark, "test")
    token_orc.write(docs, path, P.path("word_bpe_49k.json"), 1, 1)
    table = spark.read.orc(path)
    assert _read_rows(table) == 6000
    assert 0 < _read_rows(table.where("doc_id IN (3000)")) <= 1000  # its row group alone, by minimum and maximum
    assert _read_rows(table.where("doc_id IN (3001)")) == 0  # inside a row group's range, but not in its Bloom filter
    got = token_orc.read(spark, path, [3000, 3001]).collect()
    assert [r.doc_id for r in got] == [3000] and got[0].start == sum(r.n_tokens for r in token_orc.read(spark, path).where("doc_id < 3000").collect())


def test_token_files_of_empty_tables_and_repeats(spark):
    docs = spark.createDataFrame([(None, "a b"), (4, "c"), (4, "c"), (2, None), (2, "")], TWO)
    for table, sizes in ((docs.limit(0), []), (docs, [(None, 3), (2, 1), (2, 1), (4, 2), (4, 2)])):
        path = common.new_path(spark, "test")
        token_orc.write(table, path, P.path("word_bpe_49k.json"), 1, 2)
        got = token_orc.checksums(token_orc.read(spark, path)).orderBy("start").collect()
        assert [(r.doc_id, r.n_tokens) for r in got] == sizes
        assert [r.start for r in got] == [sum(n for _, n in sizes[:k]) for k in range(len(sizes))]


def test_bpe_of_empty_tables_and_repeats(spark):
    docs = spark.createDataFrame([(None, "ab cd", 1), (4, "x", 1), (4, "x", 1), (2, None, 1)], TWO + ", ids int")
    path = P.path("byte_bpe_multi_50k.tiktoken")
    got = bpe.decode(bpe.encode(docs, path), path).collect()
    assert sorted((r.doc_id or 0, bytes(r.decoded)) for r in got) == [(0, b"ab cd"), (2, b""), (4, b"x"), (4, b"x")]
    assert bpe.encode(docs.limit(0), path).count() == 0


def test_quality_against_brute_force(spark):
    """Scores from the formula of the two densities, with classes of labels that are clear and not held out."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet").select("doc_id", "quality")
    known = [(r.doc_id, r.quality) for r in labels.collect()]
    extra = spark.createDataFrame([known[0], (known[1][0], 1 - known[1][1]), (10**9, 1), (None, 1)], "doc_id long, quality int")  # repeated, contradicted, unknown, null
    texts = [r.text for r in docs.orderBy("doc_id").collect()] + [None, ""]
    x = np.concatenate([quality.statistics(np.frombuffer((t or "").encode(), np.uint8), np.array([0, len((t or "").encode())])) for t in texts])
    ids = [r.doc_id for r in docs.orderBy("doc_id").collect()]
    label = {i: q for i, q in known if zlib.crc32(str(i).encode()) % 5 and i != known[1][0]}
    own = [x[[k for k, i in enumerate(ids) if label.get(i) == c]] for c in (0, 1)]
    spreads = [np.cov(o.T, bias=True) for o in own]
    total = sum(map(len, own))
    pooled = sum(len(o) * s for o, s in zip(own, spreads, strict=True)) / total
    logs = []
    for o, s in zip(own, spreads, strict=True):
        shrunk = quality.OWN * s + quality.POOLED * pooled + quality.DIAGONAL * np.diag(np.diag(pooled)) + quality.RIDGE * np.eye(len(s))
        d = x - o.mean(0)
        logs.append(np.log(len(o) / total) - 0.5 * np.linalg.slogdet(shrunk)[1] - 0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(shrunk), d))
    want = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))
    more = spark.createDataFrame([(None, None), (10**8, "")], TWO)
    table = docs.select("doc_id", "text").unionByName(more).selectExpr("doc_id", "text", "1 AS score", "'y' AS x", "0 AS quality")
    got = quality.score(table, labels.unionByName(extra)).collect()
    score = {r.doc_id: r.score for r in got}
    assert len(got) == len(ids) + 2 and abs(score[None] - score[10**8]) < 1e-12
    assert np.allclose([score[i] for i in [*ids, None]], want[:-1], atol=1e-6)
    kept = quality.keep_good(table, labels.unionByName(extra))
    assert kept.columns == table.columns and {r.doc_id for r in kept.collect()} == {i for i, s in score.items() if s >= quality.THRESHOLD}
    assert quality.keep_good(table.limit(0), labels).count() == 0


def test_suffixes_and_backward_search():
    rng = np.random.default_rng(4)
    for strings in ([b"abcabcabcabcabc", b"xxabcabcx", b"", b"zzzzzzzzzzzz"], [bytes(rng.choice(list(b"ab"), int(n)).tolist()) for n in rng.integers(0, 60, 40)]):
        index = run_index.RunIndex(strings)
        assert index.lengths.sum() == index.n == sum(map(len, strings)) + len(strings)
        for pattern in (b"abc", b"a", b"bb", b"zz", b"xa", b"abab", b"q", b"cabcabcabcabc"):
            assert index.occurrences(pattern) == sum(x.startswith(pattern, k) for x in strings for k in range(len(x))), pattern
    symbols = np.concatenate([rng.integers(5, 8, 300), [0], rng.integers(5, 8, 300), [1]])
    assert run_index.suffix_array(symbols).tolist() == sorted(range(len(symbols)), key=lambda k: symbols[k:].tolist())


def test_pipeline_against_brute_force(spark):
    """All stages one after the other in Python, by the scores and spans that other tests hold against brute force."""
    import tiktoken

    sf = "/root/testdata/sf0.001"
    docs = common.documents(spark, sf)
    scores = {r.doc_id: r.score for r in quality.score(docs, spark.read.parquet(f"{sf}/labels.parquet")).collect()}
    rows = sorted((r.doc_id, r.text) for r in docs.collect() if scores[r.doc_id] >= quality.THRESHOLD)
    comps = brute_components([t for _, t in rows])
    rows = [r for k, r in enumerate(rows) if comps[k] == k]
    windows = brute_windows([r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()])
    rows = [r for r in rows if not brute_hits(r[1], windows)]
    spans = {r.doc_id: r.spans for r in pii.scan(spark.createDataFrame(rows, TWO)).collect()}
    assert 0 < len(rows) < docs.count() and any(spans.values())
    path = P.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    exact = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {}
    for i, text in rows:
        out, at = "", 0
        for x in spans[i]:
            if x.start >= at:
                out += text[at : x.start] + f"[{x.kind.upper()}]"
            at = max(at, x.end)
        out += text[at:]
        ids = exact.encode_ordinary(out)
        want[i] = (len(ids), np.array(ids, "<u4").tobytes(), hashlib.sha256(out.encode()).hexdigest())
    got = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id: (r.n_tokens, bytes(r.ids), r.decoded_sha256) for r in got} == want and len(got) == len(want)
