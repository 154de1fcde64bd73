"""Operators on whole tables against plain Python, over nulls, empty and long texts, ties, repeated rows, empty tables and extra columns."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from pyspark.sql import functions as F

import corpus_pipeline
from speechmill.llm import backoff_lm, jaccard_join, license_scan, mixing, stream_dedup, toxicity, url_filter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, key long, cid long, speechmill_e long"


def made():
    rng = random.Random(7)
    words = [f"w{i}" for i in range(300)]
    base = [" ".join(rng.choices(words, k=k)) for k in (3, 5, 40, 60, 80, 120, 9000)]
    out = [None, "", "  ", " \t\n", "a b", "A  b", "a\tb", *base, base[3].upper(), base[3] + " end", base[3]]
    for _ in range(40):  # near copies, some near enough
        w = rng.choice(base[2:6]).split()
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = rng.choice(words)
        out.append(" ".join(w))
    rows = [(i * 3 + 1, t, rng.choice(["en", "de", None]), rng.choice(["src1", "src7", None, "x"]), 0, "d", 1, 2, 3) for i, t in enumerate(out)]
    return rows + [rows[8], rows[12]]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(made(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def shingles(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def classes(rows):
    sets, name = [shingles(r[1]) for r in rows], list(range(len(rows)))

    def root(i):
        while name[i] != i:
            i = name[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if rows[i][0] == rows[j][0] or (a and b and 100 * len(a & b) >= 80 * len(a | b)):
                name[root(i)] = root(j)
    least = {}
    for i, r in enumerate(rows):
        least[root(i)] = min(least.get(root(i), r[0]), r[0])
    return {r[0]: (len(sets[i]), least[root(i)]) for i, r in enumerate(rows)}


def test_op2_brute_force(docs):
    want = classes(made())
    got = jaccard_join.near_duplicates(docs).collect()
    assert len(got) == len(made()) and all((r.n_shingles, r.component_id) == want[r.doc_id] for r in got)


@pytest.mark.parametrize("n, m, shared", [(40, 39, 36), (100, 99, 89), (140, 139, 124)])
def test_op2_sizes_where_less_is_left_out(spark, n, m, shared):
    """The least overlap that links, with the own shingles of the smaller text first in the order of tokens."""
    from speechmill.llm.common import shingle_sets

    words = [f"c{i}" for i in range(shared + 4)]
    least, small, k = min(shingle_sets([" ".join(words)], 5)[0]), list(words), 0
    while len(small) < m + 4:
        k += 1
        if shingle_sets([" ".join([*small[-4:], f"s{k}"])], 5)[0][0] < least:
            small.append(f"s{k}")
    large = words + [f"l{i}" for i in range(n - shared)]
    rows = [(1, " ".join(large)), (2, " ".join(small))]
    assert 100 * shared >= 80 * (n + m - shared)
    got = jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(tuple(r) for r in got) == [(1, n, 1), (2, m, 1)]


def test_op3_brute_force(docs):
    groups = {}
    for r in made():
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or ""), []).append(r[0])
    got = stream_dedup.deduplicate(docs).collect()
    by = {i: (t, ids) for t, ids in groups.items() for i in ids}
    for r in got:
        t, ids = by[r.doc_id]
        assert (r.keep_id, r.group_size, r.text_sha256) == (min(ids), len(ids), hashlib.sha256(t.encode()).hexdigest())
    assert len(got) == len(made()) and sum(r.kept for r in got) == len(groups)


def test_op3_hits_are_checked_by_their_bytes(docs):
    """With a digest that clashes for all texts, the full text decides."""
    from pyspark.sql import functions as F

    a = {(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in stream_dedup.deduplicate(docs, lambda t: F.lpad(F.length(t).cast("string"), 2, "0").substr(1, 1)).collect()}
    assert a == {(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in stream_dedup.deduplicate(docs).collect()}


def test_op4_budgets(docs):
    rows = mixing.select(docs).collect()
    total = sum(len((r[1] or "").split()) for r in made())
    assert abs(sum(r.taken for r in rows) - math.floor(total * mixing.BUDGET_SHARE)) <= 40
    assert all(0 < r.taken <= r.n_tokens for r in rows) and {r.epoch for r in rows} <= {0, 1}
    small = {(r.doc_id, r.epoch) for r in mixing.select(docs, budget_share=0.2).collect()}
    assert small


def test_op9_brute_force(docs):
    texts = [[w for w in re.split(r"[\x20\x09-\x0D]+", (r[1] or "").lower()) if w] for r in made()]
    counts = Counter(tuple(w[i : i + k]) for w in texts for k in (1, 2, 3) for i in range(len(w) - k + 1))
    total = sum(len(w) for w in texts)

    def s(w, i, k):
        g = tuple(w[i - k + 1 : i + 1])
        if k == 1:
            return max(counts[g] / total, backoff_lm.FLOOR)
        return counts[g] / counts[g[:-1]] if counts[g] >= 2 else 0.4 * s(w, i, k - 1)

    want = {r[0]: sum(math.log(s(w, i, min(3, i + 1))) for i in range(len(w))) for r, w in zip(made(), texts, strict=True)}
    got = backoff_lm.score(docs).collect()
    assert len(got) == len(made())
    assert all(r.log_score == pytest.approx(want[r.doc_id], rel=1e-6, abs=1e-9) for r in got)
    assert all((r.mean_log_score is None) == (r.n_tokens == 0) for r in got)


def test_op9_parts_and_buckets(docs):
    """Texts are cut once into parts; parts of a few documents and buckets of a few n-grams give the same scores as one of each."""
    parts = backoff_lm.encoded(docs, 200).collect()
    assert len(parts) > 3 and len({r.part for r in parts}) == len(parts) and sum(len(r.doc_id) for r in parts) == len(made())
    assert sum(r.n_words for r in parts) == sum(len(r.codes) for r in parts) == sum(len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in made())
    scored = lambda n, size, group: sorted((r.doc_id, round(r.log_score, 6)) for r in backoff_lm.score(docs, parts=n, part_bytes=size, group=group).collect())
    one, many = scored(1, 1 << 20, 1 << 20), scored(2, 200, 100)
    assert [i for i, _ in many] == [i for i, _ in one] and [s for _, s in many] == pytest.approx([s for _, s in one]) and len(many) == len(made())


def test_op1_rules_and_method(spark):
    good = [(i, f"https://a{i % 50}.example.net/en/good-story-{i}", 1) for i in range(200)]
    bad = [(1000 + i, f"http://b{i % 50}.other.net/zzqq{i}", 1) for i in range(200)]
    asked = [(1, "HTTP://X.NET/en?q", None), (2, "s://example.net/en/", None), (3, "s://example.network/", None), (4, None, None), (5, "no host", None), (6, "s://example.com/de/x#y", None), (7, "s://a.org/fr/", None), (8, "s://notnet/", None), (9, "s://net/", None)]
    got = {r.page_id: r for r in url_filter.judge(spark.createDataFrame([(i + 5000, u, r) for i, u, r in asked] + good + bad, "page_id long, url string, rule int")).collect()}
    rules = {k: (got[5000 + k].host, got[5000 + k].path, got[5000 + k].rule) for k, *_ in asked}
    assert rules == {1: ("x.net", "/en", "net/"), 2: ("example.net", "/en/", "example.net/en/"), 3: ("example.network", "/", None), 4: ("", "", None), 5: ("", "", None), 6: ("example.com", "/de/x", "example.com/de/"), 7: ("a.org", "/fr/", "org/fr/"), 8: ("notnet", "/", None), 9: ("net", "/", "net/")}
    assert got[5001].verdict == "block" and got[5002].verdict == "allow" and got[5004].verdict == "allow"
    model = url_filter.train(spark.createDataFrame(good + bad, "page_id long, url string, rule int"))
    s = model.scores([b"a1.example.net/en/good-story-77", b"b3.other.net/zzqq9"])
    assert s[0] > model.threshold > s[1]


def test_op5_held_out(spark):
    rng = random.Random(2)
    plain = [f"p{i}" for i in range(200)]
    rows, labels = [], []
    for i in range(1500):
        w, bad = rng.choices(plain, k=30), i % 5 == 0
        if bad:
            w[rng.randrange(30)] = "vileword"
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    docs = spark.createDataFrame([*rows, (9001, None), (9002, "")], "doc_id long, text string")
    got = toxicity.score(docs, toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))).collect()
    truth = dict(labels)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95 and len(got) == 1502 and all(0 <= r.score <= 1 for r in got)


def test_op8_finds_named_families(spark):
    docs = spark.createDataFrame([(1, "some words here\nLicensed under the Apache License, Version 2.0."), (2, "he lost his driving license"), (3, None), (4, "")], "doc_id long, text string")
    got = {r.doc_id: (r.families, r.n_licensed, r.first_paragraph) for r in license_scan.scan(docs).collect()}
    assert got == {1: ("apache-2.0", 1, 1), 2: ("", 0, None), 3: ("", 0, None), 4: ("", 0, None)}


def test_op8_finds_wrapped_licences(spark):
    texts = {
        1: "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Everyone is permitted to copy",
        2: "                                 Apache License\n                           Version 2.0, January 2004",
        4: "Apache License\n\nVersion 2.0, January 2004",
    }
    plain = [(100 + i, f"the river runs by house {i}\nand the men went home") for i in range(50)]
    docs = spark.createDataFrame([*texts.items(), *plain], "doc_id long, text string")
    got = {r.doc_id: (r.families, r.n_licensed, r.first_paragraph) for r in license_scan.scan(docs).collect()}
    assert [got[k] for k in texts] == [("gpl-3.0", 1, 0), ("apache-2.0", 1, 0), ("", 0, None)]
    assert all(got[k] == ("", 0, None) for k, _ in plain)


def test_empty_tables(none):
    assert jaccard_join.near_duplicates(none).count() == 0
    assert stream_dedup.deduplicate(none).count() == 0
    assert mixing.select(none).count() == 0
    assert backoff_lm.score(none).count() == 0
    assert toxicity.score(none, toxicity.fit([], [], 0.5)).count() == 0


def test_pipeline_stages(spark, docs):
    """Each filtering stage keeps the columns, and leaves what brute force leaves."""
    once = stream_dedup.keep_first(docs)
    assert once.columns == docs.columns
    groups = {}
    for r in made():
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or ""), []).append(r[0])
    assert sorted(r.doc_id for r in once.select("doc_id").collect()) == sorted(min(x) for x in groups.values())
    left = jaccard_join.keep_first(docs)
    want = classes(made())
    assert left.columns == docs.columns and {r.doc_id for r in left.select("doc_id").collect()} == {d for d, (_, c) in want.items() if c == d}
    assert mixing.mix(docs, max_epochs=1).columns == docs.columns
    assert [k for k, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "n-gram Jaccard join", "mixing sources to target weights", "byte-level BPE encoding and decoding"]


def test_rows_that_repeat_or_miss_their_ids(spark):
    """Stages go by rows, not by doc_id: nothing is lost with an id that repeats or is null."""
    text = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(1, text, "at1"), (2, text + " thirteen", "at2"), (2, "something else that stands alone here", "at3"), (None, text, "at4"), (None, None, "at5"), (None, "", "at6"), (7, "with no id the next ones differ", "at7"), (7, "with no id the next ones differ", "at8")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, at string").withColumns({"lang": F.lit("en"), "source": F.lit("src1"), "mark": F.lit(1), "_metadata": F.lit("own")})
    once = stream_dedup.keep_first(docs)
    assert once.columns == docs.columns
    got = {r["at"] for r in once.collect()}
    assert {"at1", "at2", "at3"} <= got and len(got & {"at7", "at8"}) == 1 and len(got & {"at5", "at6"}) == 1 and len(got) == 5
    left = jaccard_join.keep_first(docs)
    assert left.columns == docs.columns
    got = {r["at"] for r in left.collect()}
    assert {"at1", "at3", "at5", "at6"} <= got and len(got & {"at7", "at8"}) == 1 and len(got) == 5
    mixed = mixing.mix(docs, budget_share=1.0, max_epochs=1)
    assert mixed.columns == docs.columns and sorted(r["at"] for r in mixed.collect()) == ["at1", "at2", "at3", "at4", "at7", "at8"]
    part = mixing.mix(docs, budget_share=0.5, max_epochs=1).collect()
    assert 0 < len(part) < 6
    for stage in (stream_dedup.keep_first, jaccard_join.keep_first, mixing.mix):
        assert stage(docs.limit(0)).count() == 0


def test_mix_keeps_what_select_takes(docs):
    for options in ({"budget_share": 0.9, "max_epochs": 1}, {}):
        ids = sorted(r.doc_id for r in mixing.select(docs, **options).collect())
        assert ids == sorted(r.doc_id for r in mixing.mix(docs, **options).collect())


def test_pipeline_against_brute_force(spark, tmp_path):
    """run() on small tables: toxic ones by the scores of op5, copies and near copies by plain sets, mixing by its SQL, ids by the library."""
    import base64

    import duckdb
    import public_tokenizers as P
    import tiktoken

    small = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    copies = small.where("doc_id % 7 = 0").select((F.col("doc_id") + 100000).alias("doc_id"), F.concat("text", F.lit(" ")).alias("text"), "lang", "source", "n_chars")
    odd = spark.createDataFrame([(200000, None, None, None, 0), (200001, "", "en", "src3", 0)], small.schema)
    small.unionByName(copies).unionByName(odd).coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet("/root/testdata/sf0.001/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = toxicity.score(docs, toxicity.train(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))).where("predicted = 0")
    kept = {r.doc_id for r in kept.collect()}
    rows = sorted((r for r in docs.collect() if r.doc_id in kept), key=lambda r: r.doc_id)
    assert 0 < len(rows) < docs.count()
    seen, once = set(), []
    for r in rows:
        text = re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "")
        if text not in seen:
            seen.add(text)
            once.append(r)
    near = classes([(r.doc_id, r.text) for r in once])
    left = [r for r in once if near[r.doc_id][1] == r.doc_id]
    con = duckdb.connect()
    spark.createDataFrame(left, docs.schema).coalesce(1).write.parquet(f"{tmp_path}/left.parquet")
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/left.parquet/*.parquet'")
    chosen = {r[0] for r in con.execute(f"SELECT doc_id FROM ({mixing.oracle(0.9, 1)})").fetchall()}
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = sorted((r.doc_id, len(x := enc.encode_ordinary(r.text)), hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest(), hashlib.sha256(r.text.encode()).hexdigest()) for r in left if r.doc_id in chosen)
    got = sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert got == want and len(got) > 20
