"""Near-dedup, substring dedup and decontamination: against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from sumweave.llm import decontamination as dc
from sumweave.llm import near_dedup as nd
from sumweave.llm import substring_dedup as sd
from sumweave.llm.textbytes import Texts

R = random.Random(8)
WORDS = ["".join(R.choice("abcdefgh") for _ in range(R.randrange(2, 7))) for _ in range(3000)]


def some_text(n):
    return " ".join(R.choice(WORDS) for _ in range(n))


def edited(text, n):
    words = text.split(" ")
    for _ in range(n):
        words[R.randrange(len(words))] = R.choice(WORDS)
    return " ".join(words)


def texts_of(rows):
    raw = [(t or "").encode() for t in rows]
    return Texts(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64))


def documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def shingles(text):
    w = (text or "").encode().split()
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def similarity(a, b):
    both = sum((a & b).values())
    return both / max(1, sum(a.values()) + sum(b.values()) - both)


def brute_classes(rows):
    bags, up = [shingles(t) for _, t in rows], list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if bags[i] and bags[j] and similarity(bags[i], bags[j]) >= 0.8:
                up[root(i)] = root(j)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[root(i)].append(rows[i][0])
    return {rows[i][0]: min(groups[root(i)]) for i in range(len(rows))}


def near_rows():
    base = [some_text(n) for n in (200, 150, 80, 40, 300, 120)]
    rows = [*base, *(base[k % 6] for k in range(12))]
    rows += [edited(base[0], k % 6) for k in range(40)] + [edited(b, 1) for b in base] + [edited(base[4], k) for k in range(1, 15)]
    rows += [some_text(100) for _ in range(30)] + ["a b c", "a b c", "a b", "x", ("rep eat " * 60).strip(), ("rep eat " * 66).strip(), ("rep eat " * 20).strip(), None, "", " \n"]
    return list(enumerate(rows))


def test_near_duplicates(spark):
    rows = near_rows()
    got = {r["doc_id"]: r["class_id"] for r in nd.query(documents(spark, rows)).collect()}
    assert got == brute_classes(rows)


def test_near_duplicates_edge_rows(spark):
    text = some_text(60)
    rows = [(None, text), (None, text), (4, text), (4, text), (None, None), (9, None), (None, some_text(30))]
    got = sorted(map(tuple, nd.query(documents(spark, rows)).collect()), key=repr)
    assert got == sorted([(None, 4), (None, 4), (4, 4), (4, 4), (None, None), (9, 9), (None, None)], key=repr)
    df = spark.createDataFrame([(3, text, "a", 1), (2, text, "b", 2), (2, text, "b", 2)], "doc_id long, text string, key string, row int")
    assert [tuple(r) for r in nd.one_of_each(df).collect()] == [(2, text, "b", 2)]
    assert nd.query(documents(spark, [])).count() == 0


def test_near_duplicates_of_very_long_texts(spark):
    long = some_text(200_000)
    rows = [(1, long), (2, edited(long, 3000)), (3, long[: len(long) // 2]), (4, some_text(30)), (5, "x" * 2_000_000)]
    extra = spark.createDataFrame([(*r, "a", 1, 2) for r in rows], "doc_id long, text string, bands string, size int, key int")
    assert {r["doc_id"]: r["class_id"] for r in nd.query(extra).collect()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5}


def test_signatures_estimate_weighted_jaccard():
    a = ("one two three four five " * 9 + some_text(150)).strip()
    pairs = [(a, edited(a, k)) for k in (0, 3, 8, 20)] + [("x y z u v w " * 10, "x y z u v w " * 4)]
    for x, y in pairs:
        t = texts_of([x, y])
        sig = nd.signatures(2, *nd.bags(t), size=1024)
        want = similarity(shingles(x), shingles(y))
        assert abs((sig[0] == sig[1]).mean() - want) < 0.06, want


def family(n, q=17, together=12):
    """n texts of one template, all below 0.8 to each other (about 0.75), but of every `together` texts two are at 0.80 or
    a bit more. Each has q edits at the points of its own polynomial, so no two texts share many places."""
    rows, r = [], random.Random(5)
    for i, code in enumerate(r.sample(range(q**3), n)):
        text = [f"t{k}" for k in range(5 * q * q)]
        for g in range(q):
            of = before if i % together == 1 and g >= 13 else (i, code)
            p = 5 * (g * q + (of[1] + of[1] // q * g + of[1] // q**2 * g * g) % q)
            text[p : p + 2] = f"e{of[0]}x{p}", f"f{of[0]}x{p}"
        before = i, code
        rows.append((i, " ".join(text)))
    r.shuffle(rows)
    return rows


def family_classes(rows):
    """As brute_classes, for texts whose shingles are all different: overlaps as a matrix product."""
    bags = [shingles(t) for _, t in rows]
    assert all(max(b.values()) == 1 for b in bags)
    place = {g: k for k, g in enumerate(g for g, n in Counter(g for b in bags for g in b).items() if n > 1)}
    held = np.zeros((len(rows), len(place)), np.float32)
    for i, b in enumerate(bags):
        held[i, [place[g] for g in b if g in place]] = 1
    met, size = held @ held.T, np.array([len(b) for b in bags])
    near, least = met >= 0.8 * (size[:, None] + size - met) - 1e-3, np.array([d for d, _ in rows])
    while True:
        then = np.where(near, least[None, :], 10**9).min(1)
        if (then == least).all():
            return {d: c for (d, _), c in zip(rows, least.tolist(), strict=True)}
        least = then


def test_many_candidates_just_below_the_similarity(spark):
    rows = family(400)
    want = family_classes(rows)
    assert 350 < len(set(want.values())) < 380
    assert {r["doc_id"]: r["class_id"] for r in nd.query(documents(spark, rows)).collect()} == want


@pytest.mark.parametrize("piece", [nd.PIECE, 100])
def test_bucket_of_many_pieces(spark, monkeypatch, piece):
    monkeypatch.setattr(nd, "PIECE", piece)
    rows = family(1300)
    want = family_classes(rows)
    assert 1150 < len(set(want.values())) < 1250
    assert {r["doc_id"]: r["class_id"] for r in nd.query(documents(spark, rows)).collect()} == want


def test_links_that_signatures_underestimate(spark):
    pairs = []
    for _ in range(4000):
        words = [f"w{R.randrange(10**9)}" for _ in range(94)]
        pair = " ".join(words), " ".join(f"x{R.randrange(10**9)}" if p in (15, 45) else w for p, w in enumerate(words))
        pairs.append(pair)
    t = texts_of([x for p in pairs for x in p])
    sig = nd.signatures(t.n, *nd.bags(t))
    code, bands = (sig & np.uint64(255)), nd.band_hashes(sig)
    odd = [k for k in range(len(pairs)) if (code[2 * k] == code[2 * k + 1]).mean() < 0.7 and (bands[2 * k] == bands[2 * k + 1]).any()]
    assert odd and all(similarity(*map(shingles, pairs[k])) >= 0.8 for k in odd)
    got = nd.query(documents(spark, [(2 * k + j, pairs[k][j]) for k in odd for j in (0, 1)])).collect()
    assert {(r["doc_id"], r["class_id"]) for r in got} == {(2 * k + j, 2 * k) for k in odd for j in (0, 1)}


def brute_windows(rows, width=35):
    split = [(i, (t or "").encode().split()) for i, t in rows]
    counts = Counter(tuple(w[j : j + width]) for _, w in split for j in range(len(w) - width + 1))
    out = []
    for i, w in split:
        gone = [False] * len(w)
        for j in range(len(w) - width + 1):
            if counts[tuple(w[j : j + width])] > 1:
                gone[j : j + width] = [True] * width
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        out.append((i, len(w), len(w) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("most", [sd.ENTRIES, 1])
def test_substrings(spark, monkeypatch, most):
    p = [some_text(60) for _ in range(4)]
    rows = [(None, None), (1, ""), (2, "x " * 200), (3, "x " * 40), (4, "a b " * 100), (5, p[0]), (5, p[0]), (6, f"q {p[1][:150]} z {p[1]}"), (7, f"{p[2]}\n\t{p[2]}"), (8, " ".join(p)), (None, p[3]), (9, "y " * 34), (10, "y " * 35)]
    rows += [(20 + k, f"{some_text(R.randrange(40))} {p[k % 2]} {some_text(30)}") for k in range(30)] + [(60, some_text(36)), (61, p[0].upper())]
    # phrases of 8 to 36 words in many contexts; some windows around them occur twice
    for n in (8, 20, 30, 34, 35, 36):
        phrase, ends = some_text(n), [(some_text(30), some_text(30)) for _ in range(8)]
        rows += [(100 * n + k, f"{some_text(9)} {a} {phrase} {b} {some_text(9)}") for k, (a, b) in enumerate(ends + [(ends[0][0], ends[1][1]), (ends[2][0], some_text(30)), (some_text(30), ends[3][1])])]
    whole = sd.duplicate_ranges
    monkeypatch.setattr(sd, "duplicate_ranges", lambda df, window=35: whole(df, window, most=most))
    assert sorted(map(tuple, sd.query(documents(spark, rows)).collect()), key=repr) == brute_windows(rows)


def test_factors_are_greedy():
    r = random.Random(1)
    for _ in range(200):
        entries = [[r.randrange(2) for _ in range(r.randrange(3, 12))] for _ in range(r.randrange(1, 6))]
        words, offs = np.array([w for e in entries for w in e], np.uint64), np.concatenate([[0], np.cumsum([len(e) for e in entries])])
        copies = np.array([r.choice([1, 1, 1, 2]) for _ in entries])
        places = [(k, i) for k, e in enumerate(entries) for i in range(len(e))]

        def alike(x, y):
            a, b = entries[x[0]][x[1] :], entries[y[0]][y[1] :]
            return next((n for n, (p, q) in enumerate(zip(a, b, strict=False)) if p != q), min(len(a), len(b)))

        want = {x: max([alike(x, y) for y in places if y != x] + [0]) for x in places}
        assert sd.matches(words, offs).tolist() == list(want.values())
        spans = []
        for k, e in enumerate(entries):
            i = 0
            while i + 3 <= len(e):
                n = len(e) - i if copies[k] > 1 else want[k, i]
                if n >= 3:
                    spans.append((k, i, i + n))
                i += n - 2 if n >= 3 else 1
        assert sorted(zip(*(x.tolist() for x in sd.parse(words, offs, copies, 3)), strict=True)) == spans


def test_substrings_of_a_very_long_text(spark):
    text = some_text(20_000)
    rows = [(1, f"{text} {some_text(50)} {text[3000:5000]}"), (2, text[100_000:101_000]), (3, some_text(10))]
    extra = spark.createDataFrame([(*x, "a", 1, 2) for x in rows], "doc_id long, text string, anchor string, _th int, gone int")
    assert sorted(map(tuple, sd.query(extra).collect()), key=repr) == brute_windows(rows)


def test_substrings_of_no_documents(spark):
    assert sd.query(documents(spark, [])).count() == 0


def words_of(text):
    return re.findall(r"(?:[a-z0-9]|[^\x00-\x7f])+", (text or "").translate(str.maketrans({chr(65 + k): chr(97 + k) for k in range(26)})))


ITEMS = [(k, some_text(R.randrange(15, 60)) + R.choice(["", "\n" + some_text(6)])) for k in range(40)] + [(90, "tiny item"), (91, None), (92, "")]


def test_decontamination(spark):
    rows = [(k, f"{some_text(R.randrange(300))} {ITEMS[k % 40][1].upper()}! {some_text(R.randrange(300))}") for k in range(60)]
    rows += [(100 + k, some_text(200)) for k in range(20)] + [(200, None), (201, ""), (None, ITEMS[3][1]), (202, ITEMS[5][1]), (202, ITEMS[5][1]), (203, "a Tiny, item"), (204, " ".join(ITEMS[7][1].split()[: len(ITEMS[7][1].split()) // 2]))]
    bags = {i: {tuple(w[j : j + min(5, len(w))]) for j in range(len(w) - min(5, len(w)) + 1)} for i, t in ITEMS if (w := words_of(t))}
    want = []
    for d, t in rows:
        w = words_of(t)
        for i, bag in bags.items():
            k = len(next(iter(bag)))
            if len(bag & {tuple(w[j : j + k]) for j in range(len(w) - k + 1)}) >= 0.8 * len(bag):
                want.append((d, i))
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = dc.query(documents(spark, rows), items)
    assert sorted(((r["doc_id"], r["item_id"]) for r in got.collect()), key=repr) == sorted(want, key=repr)
    assert sorted((r["doc_id"] for r in dc.clean(documents(spark, rows), items).collect()), key=repr) == sorted((d for d, _ in rows if d not in {d for d, _ in want}), key=repr)
    assert dc.query(documents(spark, []), items).count() == 0 and dc.query(documents(spark, rows), items.where("item_id < 0")).count() == 0


def local_index(items):
    """All items in one index, without Spark."""
    found = [(i, b) for (i, _), b in zip(items, dc.bags([t for _, t in items]), strict=True) if b is not None]
    df = Counter(x for _, b in found for x in b.terms.tolist())
    totals = dc.Totals(len(found), sum(b.length for _, b in found) / len(found), max(b.words for _, b in found))
    return dc.Index.build([(i, b, np.array([df[x] for x in b.terms.tolist()])) for i, b in found], totals)


def brute_scores(rows, items):
    """(document, item) to its row's figures, by trying the window of every word that starts a shingle."""
    split = {i: w for i, t in items if (w := words_of(t))}
    grams = {i: [tuple(w[j : j + min(5, len(w))]) for j in range(len(w) - min(5, len(w)) + 1)] for i, w in split.items()}
    df, mean, longest = Counter(g for x in grams.values() for g in set(x)), sum(map(len, grams.values())) / len(grams), max(map(len, split.values()))
    out = {}
    for i, t in items:
        if i not in split:
            continue
        tf, n = Counter(grams[i]), len(grams[i])
        tail = len(words_of(t.split("\n")[-1])) if "\n" in t else len(t.split()) // 3
        answer = {g for j, g in enumerate(grams[i]) if j + len(g) // 2 >= len(split[i]) - tail}
        impact = {g: np.log(1 + (len(grams) - df[g] + 0.5) / (df[g] + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * n / mean)) for g, f in tf.items()}
        least = sum(sorted(impact.values())[: int(np.ceil(0.8 * len(impact)))])
        width = 2 * (max(128, 2 * longest) // 2)
        for d, text in rows:
            w, k = words_of(text), len(next(iter(tf)))
            at = [(j, g) for j in range(len(w) - k + 1) if (g := tuple(w[j : j + k])) in tf]
            best = ()
            for j, _ in at:
                met = {g for x, g in at if j <= x and x + k <= j + width}
                parts = [len(met & p) / len(p) if p else 1.0 for p in (set(tf) - answer, answer)]
                if len(met) >= 0.8 * len(tf) - 1e-9 and min(parts) >= 0.5:
                    best = max(best, (round(len(met) / len(tf), 9), round(sum(impact[g] for g in met) / least, 9), *(round(x, 9) for x in parts)))
            if best:
                out[d, i] = best
    return out


@pytest.mark.parametrize("most", [dc.INDEX_TERMS, 200])
def test_scores_for_any_split_into_indexes(spark, monkeypatch, most):
    monkeypatch.setattr(dc, "INDEX_TERMS", most)
    r = random.Random(2)
    cut = lambda t: " ".join(w for w in t.split(" ") if r.random() < 0.99)
    rows = [(k, f"{some_text(50)} {cut(ITEMS[k][1])} {some_text(20)} {ITEMS[(k + 1) % 40][1]}") for k in range(30)]
    got = dc.query(documents(spark, rows), spark.createDataFrame(ITEMS, "item_id long, text string")).collect()
    found = {(x["doc_id"], x["item_id"]): tuple(round(x[c], 9) for c in ("overlap", "score", "question_overlap", "answer_overlap")) for x in got}
    want = brute_scores(rows, ITEMS)
    assert len(got) == len(found) and found.keys() == want.keys() and all(np.allclose(found[k], want[k], atol=1e-6) for k in want)


@pytest.mark.parametrize("kind", ["int", "long", "string"])
def test_types_of_ids(spark, kind):
    rows = [(1, f"{some_text(20)} {ITEMS[3][1]}", "x", 5), (None, ITEMS[4][1], "x", 5)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, item_id string, score int")
    items = spark.createDataFrame([*ITEMS, (None, ITEMS[4][1])], "item_id long, text string").selectExpr(f"cast(item_id as {kind}) item_id", "text", "1 as row", "2 as df")
    got = {(r["doc_id"], r["item_id"]) for r in dc.query(docs, items).collect()}
    assert got == {(1, {"string": "3"}.get(kind, 3)), (None, {"string": "4"}.get(kind, 4)), (None, None)}
    assert dc.clean(docs, items).count() == 0 and dc.clean(docs, items.where("item_id = 7")).collect() == docs.collect()


def test_decontamination_of_a_very_long_text(spark):
    text = some_text(300_000)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = dc.query(documents(spark, [(1, f"{text} {ITEMS[5][1]}"), (2, text)]), items).collect()
    assert [(r["doc_id"], r["item_id"]) for r in got] == [(1, 5)]


def test_items_with_gaps_at_any_offset(spark, monkeypatch):
    question, answer = some_text(45), some_text(15)
    items = spark.createDataFrame([(1, f"{question}\n{answer}"), (2, some_text(20))], "item_id long, text string")
    # 60 words over 90 hold the item wherever they start, and over 150 they don't; the step is 64
    rows = [(k, f"{some_text(k)} {question} {some_text(30)} {answer} {some_text(100)}") for k in range(1, 130)]
    rows += [(1000 + k, f"{some_text(k)} {question} {some_text(90)} {answer} {some_text(100)}") for k in range(1, 130)]
    for many in (dc.INDEX_TERMS, 1):
        monkeypatch.setattr(dc, "INDEX_TERMS", many)
        assert sorted(r["doc_id"] for r in dc.query(documents(spark, rows), items).where("item_id = 1").collect()) == list(range(1, 130))


def test_wand_finds_all():
    index = local_index([*ITEMS[:40], *((100 + k, ITEMS[k % 7][1] + " " + ITEMS[k % 5][1]) for k in range(300))])
    for _ in range(150):
        terms = sorted(R.sample(range(len(index.terms)), R.choice([1, 5, 50, 400])))
        scores = Counter()
        for t in terms:
            for item, w in zip(*index.posting(t)[:2], strict=True):
                scores[item] += w
        least = R.choice([0.05, 0.3, 1.0])
        assert {i for i, _ in index.search(terms, least)} ^ {i for i, s in scores.items() if s >= least} <= {i for i, s in scores.items() if abs(s - least) < 1e-9}
