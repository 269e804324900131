"""Token counts, language ID, quality rules, mixing, the pipeline."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sumweave.llm import language_id as li
from sumweave.llm import mixing, quality
from sumweave.llm import token_count as tc

SF = "/root/testdata/sf0.001"
R = random.Random(6)


def documents(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


def test_token_counts(spark):
    tok = tc.tokenizer(*tc.default_vocabulary())
    rows = [(1, None), (2, ""), (3, "mail a.b@example.com now"), (4, "x " * 5000 + "12345678 10.0.0.1"), (None, "  wide   blanks \n\n it's"), (5, "漢字 é" * 50), (5, "漢字 é" * 50)]
    rows += [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = tc.query(documents(spark, rows)).collect()
    want = []
    for d, t in rows:
        text = after = t or ""
        edits = tc.redactions(text)
        for a, b, new in reversed(edits):
            after = after[:a] + new + after[b:]
        n = [(len(x), len(tok.pattern.findall(x)), len(tok.encoding.encode_ordinary(x))) for x in (text, after)]
        want.append((d, *n[0], len(edits), *n[1]))
    assert sorted((tuple(r)[:8] for r in got), key=repr) == sorted(want, key=repr)
    assert all((r["n_reencoded"] > 0) == (r["n_edits"] > 0) and r["n_reencoded"] <= 30 * r["n_edits"] for r in got)
    assert tc.query(documents(spark, [])).count() == 0


def test_token_counts_of_long_and_clashing_rows(spark):
    tok = tc.tokenizer(*tc.default_vocabulary())
    text = " ".join(f"word{k % 977} it's 10.0.0.{k % 200}" for k in range(30_000))
    rows = [(1, text, "x", 1), (2, "a" * 100_000, "x", 1)]
    got = tc.query(spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, n_edits int")).collect()
    assert {r["doc_id"]: r["n_tokens"] for r in got} == {d: len(tok.encoding.encode_ordinary(t)) for d, t, *_ in rows}
    assert {r["doc_id"]: r["n_edits"] for r in got} == {1: 30_000, 2: 0}


def test_edits_of_trees():
    tok = tc.tokenizer(*tc.default_vocabulary())
    parts = ["a", "'", "s", "'ll", " ", "  ", "\n", "\t ", "é", "1", "12", "!", "don't", "'re x", "     ", "\n\n", "漢字", "x"]
    some = lambda n: "".join(R.choice(parts) for _ in range(R.randrange(n)))
    for k in range(400):
        text = some(40) if k % 2 else " ".join(some(6) for _ in range(300))
        tree = tc.TokenTree(text, tok)
        for _ in range(5):
            a = R.randrange(len(text) + 1)
            b, new = min(len(text), a + R.choice([0, 1, 3, 50, 700])), some(6)
            tree.replace(a, b, new)
            text = text[:a] + new + text[b:]
            assert tree.text == text and tree.n_tokens == len(tok.encoding.encode_ordinary(text))
            assert tree.n_pretokens == len(tok.pattern.findall(text))


def test_language_gradients():
    rng = np.random.default_rng(0)
    p = {k: v.astype(float) for k, v in li._init(rng, 3, 5).items()}
    x, y = rng.integers(97, 110, (6, 4)), np.array([0, 1, 2, 1])
    x[4:, 1] = li.EDGE
    _, g = li.gradients(p, x, y)
    for k, v in p.items():
        places = [(int(x[0, 0]), 3), (int(x[3, 1]), 12)] if k[0] == "x" else [tuple(rng.integers(0, s) for s in v.shape) for _ in range(3)]
        for i in places:
            up, down = ({a: b.copy() for a, b in p.items()} for _ in range(2))
            up[k][i] += 1e-3
            down[k][i] -= 1e-3
            assert abs((li.gradients(up, x, y)[0] - li.gradients(down, x, y)[0]) / 2e-3 - g[k][i]) < 1e-4


def plain_labels(p, x):
    """Probabilities at each position of one sequence, a number at a time."""
    size = len(p["hf"])
    sig = lambda v: 1 / (1 + np.exp(-v))
    states = {}
    for d, places in (("f", range(len(x))), ("b", range(len(x) - 1, -1, -1))):
        h, states[d] = [0.0] * size, {}
        for t in places:
            a, u = p["x" + d][x[t]], [sum(h[i] * p["h" + d][i, j] for i in range(size)) for j in range(3 * size)]
            r, z = ([sig(a[g * size + i] + u[g * size + i]) for i in range(size)] for g in (0, 1))
            new = [np.tanh(a[2 * size + i] + r[i] * u[2 * size + i]) for i in range(size)]
            h = [(1 - z[i]) * new[i] + z[i] * h[i] for i in range(size)]
            states[d][t] = h
    out = []
    for t in range(len(x)):
        e = np.exp([sum(v * p["out"][i, k] for i, v in enumerate(states["f"][t] + states["b"][t])) + p["bias"][k] for k in range(len(p["bias"]))])
        out.append(e / e.sum())
    return np.array(out)


def test_labels_against_a_plain_loop():
    from .test_search import texts_of

    rng = np.random.default_rng(1)
    p = {k: v.astype(float) for k, v in li._init(rng, 3, 4).items()}
    x = np.array([li.EDGE, *b"ab c d", li.EDGE, li.EDGE])
    assert np.abs(li.label(p, x[:, None])[:, :, 0] - plain_labels(p, x)).max() < 1e-9
    # a label hardly depends on what is further away than the context, and a text's result not on its neighbours
    texts = ["x", "", "Some words, \t of a text " * 40, "é ü ß " * 3, "y" * (li.CORE + 1), "z" * li.CORE]
    alone = np.concatenate([li.pooled(p, texts_of([t])) for t in texts])
    assert np.abs(li.pooled(p, texts_of(texts)) - alone).max() < 1e-9
    for t, got in zip(texts, alone, strict=True):
        want = plain_labels(p, np.array(list(t.encode().lower()), int)).mean(0) if t else 0
        assert np.abs(got - want).max() < (1e-9 if len(t.encode()) <= li.CORE else 1e-3), t


def test_held_out_is_the_checksum(spark):
    ids = [None, 0, 1, -5, *range(10**9, 10**9 + 200)]
    got = spark.createDataFrame([(k,) for k in ids], "doc_id long").select("doc_id", li.held_out(F.col("doc_id")).alias("h")).collect()
    assert {r["doc_id"]: r["h"] for r in got} == {k: k is not None and zlib.crc32(str(k).encode()) % 5 == 0 for k in ids}


def test_language_accuracy_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lang = {r["doc_id"]: r["lang"] for r in docs.collect()}
    got = li.query(docs).collect()
    assert len(got) == len(lang) and all(0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["held_out"]]
    assert 0.1 < len(held) / len(got) < 0.3 and sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) > 0.97 * len(held)


def test_languages_of_long_texts_are_learned(spark):
    de, en = "der die das und nicht ", "the thing and the other "
    rows = [(k, de * 1300 if k % 2 else en * 3, "de" if k % 2 else "en") for k in range(80)] + [(200 + k, de * 3, None) for k in range(10)]
    rows += [(300 + k, "el que de la en los " * 4, "es") for k in range(6)] + [(400 + k, "漢字 仮名 漢 " * 9, "ja") for k in range(6)]
    got = li.query(documents(spark, rows, "doc_id long, text string, lang string")).collect()
    want = {r[0]: r[2] or "de" for r in rows}
    assert {r["doc_id"]: r["lang_pred"] for r in got} == want


def test_language_edge_rows(spark):
    schema = "doc_id long, text string, lang string, score string, held_out int, h string, windows int"
    odd_columns = ("x", 1, "y", 2)
    rows = [(k, "the thing and the other " * 5 if k % 2 else "der die das und nicht " * 5, "en" if k % 2 else "de", *odd_columns) for k in range(60)]
    odd = [(d, t, x, *odd_columns) for d, t, x in [(100, None, "en"), (101, "123 !?", None), (None, "the thing and the other", None), (102, "", "de"), (103, "der" * 300_000, None), (7, rows[7][1], "en")]]
    docs = documents(spark, rows + odd, schema)
    got = {r["doc_id"]: r for r in li.query(docs).collect()}
    assert [got[k]["lang_pred"] for k in (100, 101, 102)] == ["und"] * 3 and got[100]["score"] == 0
    assert got[None]["lang_pred"] == "en" and not got[None]["held_out"] and got[103]["lang_pred"] in ("de", "en")
    assert {r["lang_pred"] for r in li.query(documents(spark, odd[1:3], schema)).collect()} == {"und"} and li.query(docs.where("doc_id < 0")).count() == 0


def brute_quality(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    counts, covered = Counter(grams), set()
    for i, g in enumerate(grams):
        if counts[g] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed)


ODD = [(1, None), (2, ""), (3, "\n\n"), (4, "a b c a b c"), (None, "x\nx\n x\nx"), (5, "é # ü | <b>\n" * 40), (5, "é # ü | <b>\n" * 40), (6, "word " * 5000), (7, "a\x0bb\x0cc\u00a0d\r\n")]


def test_quality_counts(spark):
    rows = ODD + [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = quality.query(documents(spark, rows)).collect()
    assert sorted((tuple(r)[:7] for r in got), key=repr) == sorted(((d, *brute_quality(t)) for d, t in rows), key=repr)
    assert not any(r["kept"] and r["base_failed"] for r in got) and any(r["kept"] for r in got)
    assert quality.query(documents(spark, [])).count() == 0


def test_quality_of_clashing_and_long_rows(spark):
    schema = "doc_id long, text string, n_words string, kept int, base_failed int"
    rows = [(k, t, "x", 1, 2) for k, t in [(1, None), (2, "Some plain words of a text " * 200_000), (3, " ".join(f"word{j}" for j in range(200_000))), (3, " ".join(f"word{j}" for j in range(60)))]]
    got = quality.query(documents(spark, rows, schema)).collect()
    assert sorted((tuple(r)[:7] for r in got), key=repr) == sorted(((r[0], *brute_quality(r[1])) for r in rows), key=repr)
    kept = quality.keep_good(documents(spark, rows, schema))
    assert kept.columns == ["doc_id", "text", "n_words", "kept", "base_failed"] and sorted(map(tuple, kept.collect())) == sorted(r for r in rows if r[0] == 3)


def test_quality_agrees_with_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.query(docs).join(labels, "doc_id").where("not base_failed").collect()
    assert all(r["kept"] == bool(r["quality"]) for r in rows)


def test_cascade_order_changes_no_verdict():
    from .test_search import texts_of

    texts = texts_of([t for _, t in ODD] + ["plain words of some length here " * 3 + str(k) for k in range(9)])
    alone = np.logical_and.reduce([~r.rejects(quality.Features(texts)) for r in quality.RULES])
    for rules in (quality.RULES, quality.RULES[::-1]):
        assert (quality.passes(rules, quality.Features(texts)) == alone).all()


def brute_targets(sizes):
    weights = [(5, 2, 1)[k % 3] for k in range(len(sizes))]
    low, high = 0.0, 1e9
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(mid * w, 2 * s) for w, s in zip(weights, sizes, strict=True)) < 1.5 * sum(sizes) else (low, mid)
    return [min(low * w, 2 * s) for w, s in zip(weights, sizes, strict=True)]


@pytest.mark.parametrize("few", [mixing.FEW_SOURCES, 0])
def test_mixing(spark, monkeypatch, few):
    monkeypatch.setattr(mixing, "FEW_SOURCES", few)
    rows = [(k, "w " * R.randrange(1, 60), f"s{k % 7}") for k in range(3000)] + [(9000 + k, "v v v", "s1") for k in range(400)] + [(5000, "dup dup", "s2")] * 300 + [(None, None, None), (None, "one two", None), (8000, "", "ü")]
    docs = documents(spark, rows, "doc_id long, text string, source string")
    got = mixing.query(docs).collect()
    source = {s: sum(len((t or "").split()) for _, t, x in rows if x == s) for s in {r[2] for r in rows}}
    order = sorted(source, key=lambda s: (s is None, s or ""))
    want = dict(zip(order, brute_targets([source[s] for s in order]), strict=True))
    assert len(got) == len(rows) and all(r["taken"] in (0, r["size"], 2 * r["size"]) for r in got)
    by = {r["doc_id"]: r for r in got}
    name = {d: s for d, _, s in rows}
    for d, r in by.items():
        assert r["source_size"] == source[name[d]] and abs(r["target"] - want[name[d]]) < 1e-6 * max(1, r["target"])
    taken = Counter()
    for r in got:
        taken[name[r["doc_id"]]] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 60 for s in source)
    assert sorted(map(repr, got)) == sorted(map(repr, mixing.query(docs.selectExpr("*", "1 as size", "2 as n", "3 as copy", "4 as _key").repartition(3)).collect()))
    assert mixing.query(docs.where("doc_id < 0")).count() == 0


def test_many_sources_are_ranked_alike(spark):
    # some thousand sources, as hosts would be, with names whose order by code points isn't that of UTF-16
    names = [None, "", "\U0001F600", "\uffee", "Z", "a", "ä", *(f"h{k}" for k in range(3000))]
    units = spark.createDataFrame([(str(i), i, x, R.randrange(50) + (i % 97 == 0) * 10**6, 1 + i % 3) for i, x in enumerate(names)], "_key string, doc_id long, source string, size long, n long")
    few, many = (sorted(mixing.source_targets(units, k)[0].collect()) for k in (10**6, 0))
    assert [tuple(r)[:3] for r in few] == [tuple(r)[:3] for r in many] and np.allclose([r["target"] for r in few], [r["target"] for r in many], rtol=1e-9)
    assert [r["source"] for r in few] == sorted((x for x in names if x is not None), key=lambda x: [ord(c) for c in x]) + [None]
    assert np.allclose([r["target"] for r in few], brute_targets([r["source_size"] for r in few]), rtol=1e-6)


def test_a_hot_record_is_mixed_by_many_tasks(spark):
    docs = spark.range(30_000).selectExpr("7L as doc_id", "'one two' as text", "'s' as source").unionByName(spark.range(500).selectExpr("id as doc_id", "concat('w ', id) as text", "'t' as source"))
    got = mixing.query(docs).groupBy("doc_id", "taken").count().collect()
    taken = sum(r["taken"] * r["count"] for r in got if r["doc_id"] == 7 and r["taken"] != 0)
    assert sum(r["count"] for r in got) == 30_500 and abs(taken / 60_000 - 1.5) < 0.05
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    sizes = Counter(r["p"] for r in out.where("text = 'one two'").select(F.spark_partition_id().alias("p")).collect())
    assert abs(sum(sizes.values()) / 30_000 - 1.5) < 0.05 and max(sizes.values()) < 0.6 * sum(sizes.values())


def test_flights_keep_their_sums():
    for seed in range(20):
        rng = random.Random(seed)
        sizes, chance = [float(rng.randrange(1, 90)) for _ in range(200)], [rng.random() for _ in range(200)]
        out = mixing.flight(sizes, chance, rng)
        assert sum(0 < p < 1 for p in out) <= 2 and abs(sum(out) - sum(chance)) < 1e-6
        assert abs(sum(s * p for s, p in zip(sizes, out, strict=True)) - sum(s * p for s, p in zip(sizes, chance, strict=True))) < 1e-5
    means = np.mean([mixing.flight([1.0, 2.0, 3.0, 4.0, 5.0], [0.3] * 5, random.Random(k)) for k in range(4000)], 0)
    assert np.abs(means - 0.3).max() < 0.04


def test_pipeline(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, times string, row int"
    docs = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("*", "'t' AS times", "1 AS row")
    odd = spark.createDataFrame([(None, None, None, None, None, "t", 1), (3, "", "en", "src1", 0, "t", 1)], schema)
    docs = docs.unionByName(odd).unionByName(docs.limit(40))
    seen = [docs.cache()]
    for name, stage in corpus_pipeline.STAGES:
        seen.append(stage(spark, seen[-1], SF).cache())
        if name != "sharding":
            assert seen[-1].columns == docs.columns
    good, one, clean, mixed, shards = ([tuple(r) for r in df.collect()] for df in seen[1:])
    assert 0 < len(clean) <= len(one) < len(good) < docs.count() and len({r[0] for r in one}) == len(one)
    assert set(mixed) <= set(clean) and max(Counter(mixed).values()) <= 2
    assert Counter(r[0] for r in shards) == Counter(r[0] for r in mixed)
    size = lambda rows: sum(len(r[1].encode().split()) for r in rows)
    assert abs(size(mixed) - 1.5 * size(clean)) < 0.1 * size(clean)


def test_pipeline_query(spark):
    first, again = ([tuple(r) for r in corpus_pipeline.run(spark, SF).collect()] for _ in range(2))
    assert first and sorted(map(repr, first)) == sorted(map(repr, again))


@pytest.mark.parametrize("name", ["op1_near_dedup", "op4_line_dedup", "op6_substring_dedup", "op7_quality", "op8_url_filter", "op10_sharding"])
def test_registered_sql(spark, name):
    import duckdb

    from sumweave.llm import entry

    d = duckdb.connect()
    for t in ("documents", "pages"):
        d.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = entry.QUERIES[name](spark, SF), d.sql(entry.ORACLE_SQL[name])
    pick = lambda columns, rows: sorted(repr([r[columns.index(c)] for c in sorted(columns)]) for r in rows)
    assert pick(got.columns, map(tuple, got.collect())) == pick(want.columns, want.fetchall())


def test_all_operators_are_registered():
    from sumweave.llm import entry

    assert [int(n[2:].split("_")[0]) for n in entry.QUERIES] == list(range(1, 11))
