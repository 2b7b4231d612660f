"""The corpus operators against brute force, on small fixtures with nulls, empty and long texts, ties and repeats."""

import base64
import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from filigree.llm import bpe, common, decontaminate, fingerprints, jaccard_join, kd_sharding, pii, quality, queries, run_index, token_orc, wrappers

P = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"
KIND = "doc_id long, text string, lang string, source string, n_chars long, rep string, n int"
BASE = " ".join(f"word{k * 7919 % 997}" for k in range(400))
TEXTS = [
    BASE, BASE, BASE.upper(), BASE + " and a little more", BASE.replace("word7 ", "other "), None, "", "  \n ", "one two", "One Two", "a" * 5000, "ab " * 2000,
    "mail x_y@f.g.h. or a@b.c@d.e, call +1 (234) 555-1234", "4111 1111 1111 1111 at 1.2.3.4.5.6.7.8 and 999.1.1.1", "don't I'LL  it''s  \n\n x 12३ é漢🙂", "x" * 300 + BASE[200:700],
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(k, t, "en", "s", None, "clash", 1) for k, t in enumerate(TEXTS)], KIND).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], KIND)


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_removed_repeats(docs):
    got, seen = rows(run_index.without_repeats(docs)), set()
    for k, t in enumerate(TEXTS):
        own = (t or "").encode()
        gone = np.zeros(len(own), bool)
        for s in range(len(own) - 99):
            if own[s : s + 100] in seen:
                gone[s : s + 100] = True
            seen.add(own[s : s + 100])
        assert (got[k].n_bytes, got[k].n_removed) == (len(own), gone.sum()), k
        assert got[k].kept_sha256 == hashlib.sha256(np.frombuffer(own, np.uint8)[~gone].tobytes()).hexdigest()


def test_run_index_on_periodic_strings():
    strings = [b"abcabcabcabcabc", b"xxabcabcx", b"abcabcabcab", b"zzzzzzzzzzzz"]
    got, seen, want = run_index.RunIndex(strings).repeats(6), set(), []
    for s in strings:
        for k in range(len(s) + 1):
            part = s[k : k + 6]
            want.append(len(part) == 6 and part in seen)
            seen.add(part)
    assert got.tolist() == want


def test_run_index_keeps_first_places_of_repeated_rows():
    parts = [(5, 1, 0, b"x" * 400 + bytes(range(200))), (5, 2, 0, b"y" * 400 + bytes(range(200)))]

    def marks(found):
        batch = pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*found, strict=True)], ["anchor", "doc_id", "start", "bytes"])
        out = []

        class Rows:  # what arrow_map() needs of a DataFrame
            sparkSession = type("S", (), {"conf": type("C", (), {"set": staticmethod(lambda *_: None)})})  # noqa: N815

            def mapInArrow(self, run, _):  # noqa: N802
                out.extend(r for b in run(iter([batch])) for r in b.to_pylist())

        run_index.index_bundles(Rows())
        return out

    assert marks([parts[0], *parts]) == marks(parts)


def test_byte_bpe(docs):
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    exact = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    made = bpe.encode(docs, path)
    for k, r in rows(made).items():
        assert np.frombuffer(r.ids, "<u4").tolist() == exact.encode_ordinary(TEXTS[k] or ""), k
        own = (TEXTS[k] or "").encode()
        assert bpe.decode_range(r.ids, r.offsets, 3, 40, path) == own[3:40]
    assert all(r.decoded == (TEXTS[k] or "").encode() for k, r in rows(bpe.decode(made, path)).items())


def test_token_files(spark, docs, empty):
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    path = common.new_path(spark, "test")
    token_orc.write(docs.orderBy(F.desc("doc_id")), path, P.path("word_bpe_49k.json"), 1, 3)
    got, start = rows(token_orc.checksums(token_orc.read(spark, path))), 0
    for k, t in enumerate(TEXTS):
        ids = np.array([*exact.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        assert (got[k].start, got[k].n_tokens, got[k].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes())), k
        start += len(ids)
    assert token_orc.read(spark, path, [3]).count() == 1
    none = common.new_path(spark, "test")
    token_orc.write(empty, none, P.path("word_bpe_49k.json"), 1, 1)


def test_decontamination(spark, docs, empty, monkeypatch):
    items = [(1, " ".join(BASE.split()[5:25])), (2, "ONE two"), (3, None), (4, " ".join(BASE.split()[20:40])), (5, "..."), (4, "two")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    split = lambda t: word.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = {}
    for i, t in items:
        own = split(t)
        for a in range(max(1, len(own) - 9) if own else 0):
            windows.setdefault(tuple(own[a : a + 10]), set()).add(i)
    for block in (2_000_000, 15):  # the second makes several blocks of items
        monkeypatch.setattr(decontaminate, "BLOCK_WORDS", block)
        got = rows(decontaminate.matches(docs, benchmark).withColumn("n_hit", decontaminate.covered(F.col("matches"))))
        for k, t in enumerate(TEXTS):
            own, found = split(t), set()
            hit = np.zeros(len(own), bool)
            for w, ids in windows.items():
                for a in range(len(own) - len(w) + 1):
                    if tuple(own[a : a + len(w)]) == w:
                        hit[a : a + len(w)] = True
                        found |= ids
            assert (got[k].n_words, got[k].n_hit, {m.item_id for m in got[k].matches}) == (len(own), hit.sum(), found), k
    assert decontaminate.decontaminate(docs, benchmark).columns == docs.columns
    assert decontaminate.decontaminate(docs, benchmark.limit(0)).count() == len(TEXTS)
    assert decontaminate.decontaminate(empty, benchmark).count() == 0


def test_fingerprints(docs, empty):
    got = rows(fingerprints.compare_edited(docs, 3000))
    for k, t in enumerate(TEXTS):
        own, following = t or "", TEXTS[(k + 1) % len(TEXTS)] or ""
        half = len(own) // 2
        assert got[k].edited_sha256 == hashlib.sha256((own[: len(own) - half] + following[:half]).encode()).hexdigest()
    assert got[0].fingerprint == got[1].fingerprint and got[0].near_next == 1.0
    pairs = {(r.a, r.b) for r in fingerprints.near_pairs(docs).collect()}
    assert (0, 3) in pairs
    assert fingerprints.compare_edited(empty).count() == 0


def test_near_pairs_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "BLOCK_ROWS", 4)  # so that buckets are cut into blocks
    rng = np.random.default_rng(3)
    words = [f"w{k}" for k in range(300)]
    texts = []
    for _ in range(30):  # near to one another to different degrees, under smallest ids that are farther away
        own = list(words)
        for k in rng.choice(300, int(rng.integers(1, 14)), replace=False):
            own[k] = f"z{rng.integers(1 << 40)}"
        texts.append(" ".join(own))
    long = [f"l{k}" for k in range(12000)]  # two texts of nearly equal signatures, and one of an equal shingle set
    texts += [" ".join(long), " ".join([*long[:-1], "end"]), " ".join(long).upper(), texts[7], "", None, ""]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append(frozenset(zip(*(w[k:] for k in range(5)), strict=False)))
    rep = [sets.index(s) for s in sets]
    assert [r.rep for r in fingerprints.members(table).orderBy("doc_id").collect()] == rep
    heads = [k for k in sorted(set(rep)) if sets[k]]
    want = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in heads for b in heads if a < b}
    want = {k: v for k, v in want.items() if v >= 0.8}
    got = fingerprints.near_pairs(table).collect()
    assert (30, 31) in want and 20 < len(want) < 435
    assert {(r.a, r.b): r.jaccard for r in got} == want and len(got) == len(want)


def test_personal_data(docs):
    patterns = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]

    def passes(kind, m):
        digits = re.sub("[^0-9]", "", m)
        if kind == "ip":
            return all(int(p) <= 255 for p in m.split("."))
        if kind == "card":
            own = [int(c) * (1 + k % 2) for k, c in enumerate(reversed(digits))]
            return 12 <= len(digits) <= 19 and sum(v - 9 * (v > 9) for v in own) % 10 == 0
        return kind == "email" or 9 <= len(digits) <= 15

    for k, r in rows(pii.scan(docs)).items():
        want = sorted((m.start(), j, m.end()) for j, (kind, p) in enumerate(patterns) for m in re.finditer(p, TEXTS[k] or "") if passes(kind, m[0]))
        assert [(s.start, s.rank, s.end) for s in r.spans if s.rank < 4] == want, k
    out = rows(pii.redact(docs))
    assert out[5].text is None and "[EMAIL]" in out[12].text and "[PHONE]" in out[12].text and out[0].text == BASE


def test_added_kinds(spark):
    text = "Account GB82 WEST 1234 5698 7654 32 and GB82 WEST 1234 5698 7654 33, phone 555-123-4567"
    spans = spark.createDataFrame([(1, text)], "doc_id long, text string").select(pii.find(F.col("text")).alias("s")).first().s
    assert [s.kind for s in spans] == ["iban", "local_phone"]


def test_quality(spark, empty):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = quality.score(docs, labels).toPandas().merge(labels.toPandas(), on="doc_id")
    held = got[[zlib.crc32(str(k).encode()) % 5 == 0 for k in got.doc_id]]
    assert ((held.score >= quality.THRESHOLD) == held.quality).mean() > 0.93
    assert quality.score(empty, labels).count() == 0
    assert set(quality.score(docs, labels.limit(0)).select("score").distinct().toPandas().score) == {0.5}


def test_jaccard_components(docs, empty):
    word = re.compile(r"[^\x20\x09-\x0D]+")
    sets = []
    for t in TEXTS:
        own = word.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(own[k : k + 5]) for k in range(len(own) - 4)} if len(own) >= 5 else {tuple(own)} if own else set())
    comp = list(range(len(sets)))
    for _ in sets:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and 100 * len(a & b) >= 80 * len(a | b):
                    comp[i] = comp[j] = min(comp[i], comp[j])
    got = rows(jaccard_join.components_of(docs))
    assert [(got[k].n_shingles, got[k].component_id) for k in range(len(sets))] == [(len(s), c) for s, c in zip(sets, comp, strict=True)]
    assert jaccard_join.components_of(empty).count() == 0


def test_signature_trees_lose_no_link():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 200).astype(np.uint64)
    sets = [np.unique(np.concatenate([rng.choice(base, rng.integers(150, 200), replace=False), rng.integers(0, 2**63, rng.integers(0, 40)).astype(np.uint64)])) for _ in range(150)]
    ids, sizes = np.arange(150), np.array([len(s) for s in sets])
    i, j = jaccard_join.join_rows(ids, sizes, ids, [jaccard_join.bitmap(s) for s in sets], np.zeros(150, int))
    got = set(zip(np.minimum(i, j).tolist(), np.maximum(i, j).tolist(), strict=True))
    for i in range(150):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= 80 * (sizes[i] + sizes[j] - both):
                assert (j, i) in got


def test_wrappers(spark):
    page = "<html><head><title>t</title></head><body><nav><a href='/x'>menu {0}</a></nav><div class='ad'>buy</div><article><h1>Head {0}</h1><p>Text &amp; more {0}<p>Second  {0}</p><div class='share'>Share</div></article><div class='comments'><p>hi</p></div><footer>c</footer>"
    rows_ = [(k, f"http://h.example/{k}", page.format(k)) for k in range(5)] + [(5, None, None), (6, "x", ""), (7, "http://o.example", "<div><p>" + "long text " * 30 + "</p></div><div><a href=x>l</a></div>")]
    got = {r.page_id: r.text for r in wrappers.main_text(spark.createDataFrame(rows_, "page_id long, url string, html string")).collect()}
    assert got[3] == "Head 3\nText & more 3\nSecond 3"
    assert got[5] == "" and got[6] == "" and got[7] == ("long text " * 30).strip()


def extracted(spark, pages):
    table = spark.createDataFrame([(k, f"http://h.example/{k}", x) for k, x in enumerate(pages)], "page_id long, url string, html string")
    return [r.text for r in wrappers.main_text(table).orderBy("page_id").collect()]


def test_wrappers_keep_copies_of_an_article(spark):
    one = "<body><div>advert {0}</div><article><h1>Head</h1><p>Only paragraph</p><blockquote>A quote</blockquote></article>"
    assert extracted(spark, [one.format(k) for k in range(4)]) == ["Head\nOnly paragraph\nA quote"] * 4
    mixed = [one.format(k) for k in range(3)] + [f"<body><div>advert</div><article><h1>Other {k}</h1><p>Text {k}</p></article>" for k in range(9)]
    assert extracted(spark, mixed)[:3] == ["Head\nOnly paragraph\nA quote"] * 3
    bare = "<body><div><pre>made on day {0}</pre><p>The one paragraph of all of these pages</p></div>"
    assert all("The one paragraph" in x for x in extracted(spark, [bare.format(k) for k in range(4)]))
    frame = "<body><div><pre>Frame of the site</pre><p>" + "Text {0} " * 20 + "</p></div>"
    assert extracted(spark, [frame.format(k) for k in range(4)]) == [(f"Text {k} " * 20).strip() for k in range(4)]


def test_wrappers_keep_all_containers(spark):
    bare = "<body><div class='site-header'>Name</div><section class='intro'><p>Intro {0} says it</p></section><section class='body'><p>" + "Body {0} " * 30 + "</p></section><div class='ad-slot'>Buy</div>"
    assert extracted(spark, [bare.format(k) for k in range(4)]) == [f"Intro {k} says it\n" + ("Body %d " % k * 30).strip() for k in range(4)]


@pytest.mark.parametrize("around", ["<main class='with-sidebar'>{}</main>", "<article class='comments-open'>{}</article>", "<div class='search-results'>{}</div>", "<div class='search'><main id='banner'>{}</main></div>", "<div class='widget'><article>{}</article></div>"])
def test_wrappers_match_whole_names(spark, around):
    inner = "<p>Text {0} stays</p><div class='comment-list'>said</div><div class='share'>Share</div>"
    assert extracted(spark, ["<body>" + around.format(inner.format(k)) for k in range(3)]) == [f"Text {k} stays" for k in range(3)]


def test_sharding(docs, empty):
    got = kd_sharding.assign(docs, 4).toPandas()
    sizes = got.groupby("shard")["size"].sum()
    assert sorted(got.doc_id) == list(range(len(TEXTS))) and len(sizes) == 4
    assert sizes.max() - sizes.min() <= 2 * got["size"].max()
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in got.groupby("shard"))
    assert kd_sharding.assign(empty, 4).count() == 0


def test_pipeline_stages(spark):
    docs = common.documents(spark, SF)
    assert len(corpus_pipeline.STAGES) == 5
    for name, stage in corpus_pipeline.STAGES:
        out = common.written(stage(spark, docs, SF), "test")
        if name == "pii":
            assert out.count() == docs.count()
        if name != "byte_level_bpe":
            assert out.columns == docs.columns
            docs = out
    assert out.count() == docs.count()
    good = rows(corpus_pipeline.good_documents(spark, common.documents(spark, SF), SF))
    scores = rows(queries.op7_quality(spark, SF))
    assert set(good) == {k for k, r in scores.items() if r.predicted == 1}


def test_codepoint_pretokens_have_no_gap():
    text = "a  b\tc\n'll 12"
    data = np.frombuffer(text.encode(), np.uint8)
    starts, at = bpe.slices(data, np.array([0, len(data)]))
    import regex

    assert starts.tolist() == [m.start() for m in regex.finditer(P.PATTERN, text)] and at.tolist() == [0, len(starts)]
    assert pa.array(starts).type == pa.int64()


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_corpus_twin(spark, docs, tmp_path, name):
    duckdb = pytest.importorskip("duckdb")
    docs.drop("rep", "n").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    items = [(1, TEXTS[0][:90]), (2, "two ONE"), (3, None), (4, ""), (5, "one two"), (6, TEXTS[3]), (6, "ab ab")]
    spark.createDataFrame(items, "item_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
    got = queries.QUERIES[name](spark, str(tmp_path))
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({queries.ORACLE_SQL[name]})").fetchall()  # not by a data frame, in which nulls become numbers
    assert sorted(map(tuple, got.collect())) == sorted(want)
