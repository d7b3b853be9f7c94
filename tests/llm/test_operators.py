"""The corpus operators against brute force on small tables with every odd case."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from gridspark.llm import components, flac, langid, licenses, lines, merkle, minhash, mixing, packing, shards, storage, suffixes

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, component_id long, rep string, spans string"


def table(spark, rows):
    """Documents with columns whose names the operators use themselves."""
    full = [(i, t, "en", "web", len(t or ""), 7, "x", "y") for i, t in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


def words(n, seed):
    r = random.Random(seed)
    return ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8))) for _ in range(n)]


def odd_rows():
    base = words(120, 1)
    near = base[:60] + ["changed"] + base[61:]
    return [
        (1, " ".join(base)), (2, " ".join(base)), (3, " ".join(near)), (4, None), (5, ""), (6, " \n "), (7, "one two"), (8, "One  TWO"),
        (9, " ".join(words(200, 2))), (9, " ".join(words(200, 2))), (10, " ".join(words(30_000, 3))), (11, "ü ß 漢字 " * 40), (12, " ".join(base[:70])),
    ]


# --- 1 ----------------------------------------------------------------------------------------------------


def shingle_set(text):
    import re

    ws = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(ws[i : i + 5]) for i in range(len(ws) - 4)} if len(ws) >= 5 else ({tuple(ws)} if ws else set())


def classes(rows):
    sets = {i: shingle_set(t) for i, t in rows}
    least = {i: i for i in sets}
    ids, changed = sorted(sets), True
    links = [(a, b) for a in ids for b in ids if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            m = min(least[a], least[b])
            if least[a] != m or least[b] != m:
                least[a] = least[b] = m
                changed = True
    return {i: (len(sets[i]), least[i]) for i in sets}


@pytest.mark.parametrize("small", [16, 2])
def test_near_duplicates(spark, small):
    rows = odd_rows()
    r = random.Random(5)
    chain = words(100, 9)
    for k in range(20, 40):  # a chain of small edits, linked from one to the next
        chain = list(chain)
        chain[r.randrange(100)] = f"edit{k}"
        rows.append((k, " ".join(chain)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(table(spark, rows), small=small).collect()}
    assert got == classes(rows)


def test_near_duplicates_of_rows_that_share_an_id(spark):
    """Each text links by itself; a group's id is the least of its rows' ids."""
    a, b, c = words(80, 51), words(80, 52), words(80, 53)
    near = lambda w, k: " ".join([*w[:k], "edit", *w[k + 1 :]])
    rows = [(5, " ".join(a)), (5, " ".join(b)), (5, " ".join(b)), (7, near(a, 3)), (8, near(b, 70)), (9, " ".join(c)), (9, near(c, 40)), (10, near(a, 60)), (4, near(b, 2)), (3, None), (3, "x"), (None, "x")]
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(table(spark, rows)).collect())
    sets = [(i, shingle_set(t)) for i, t in rows if i is not None]
    group = list(range(len(sets)))
    for _ in sets:
        for x, (_, s) in enumerate(sets):
            for y, (_, t) in enumerate(sets):
                if s and t and 100 * len(s & t) >= 75 * len(s | t):
                    group[x] = group[y] = min(group[x], group[y])
    least = [min(i for (i, _), h in zip(sets, group, strict=True) if h == g) for g in group]
    assert got == sorted((i, len(s), m, i == m) for (i, s), m in zip(sets, least, strict=True))


def test_components_take_no_more_rounds_than_they_need(spark, monkeypatch):
    """The driver keeps a record of every task, so rounds that change nothing cost its memory: tables written, one and one a round."""
    written = []
    monkeypatch.setattr(components, "materialize", lambda df, name: written.append(name) or storage.materialize(df, name))
    r = random.Random(8)
    stars, chain = [(k, k % 5) for k in range(5, 60)], [(k, k + 1) for k in range(100, 140)]
    mixed = [(r.randrange(300), r.randrange(300)) for _ in range(200)]
    for edges, most in (([*stars, (7, 7), (90, 90), (None, 3), (5, 0)], 1), (chain, 7), (mixed, 7), ([], 1)):
        least = {v: v for e in edges if None not in e for v in e}
        for _ in least:
            for a, b in edges:
                if a is not None:
                    least[a] = least[b] = min(least[a], least[b])
        written.clear()
        got = components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
        assert sorted((x.id, x.component) for x in got) == sorted(least.items())
        assert len(written) <= most


def test_components_are_brought_up_to_date(spark):
    edges = lambda *some: spark.createDataFrame(list(some), "a long, b long")
    label = minhash._joined(None, edges((2, 1), (4, 3), (6, 5)))
    assert minhash._joined(label, edges()) is label
    got = minhash._joined(label, edges((6, 4), (9, 8))).collect()
    assert sorted((x.id, x.component) for x in got) == [(1, 1), (2, 1), (3, 3), (4, 3), (5, 3), (6, 3), (8, 8), (9, 8)]


def test_near_duplicates_of_nothing(spark):
    assert minhash.near_duplicates(table(spark, [])).count() == 0


# --- 2 ----------------------------------------------------------------------------------------------------


def test_merkle(spark):
    a, b = "One. Two.\nThree.\nFour.", "One. Two.\nThree!\nFour."
    df = spark.createDataFrame([(a, a), (a, b), (None, ""), ("", "x.")], "a string, b string")
    pa, pb = merkle.fingerprint(F.col("a")), merkle.fingerprint(F.col("b"))
    got = df.select((pa == pb).alias("same"), merkle.likeness(pa, pb).alias("near"), merkle.differing(pa, pb).alias("d")).collect()
    assert [r.same for r in got] == [True, False, True, False]
    assert got[0].near == 1.0 and 0 < got[1].near < 1 and got[2].near == 1.0 and got[3].near == 0.0
    assert got[0].d == [] and len(got[1].d) == 1


def test_edited_texts(spark):
    rows = [*odd_rows(), (9, "a shorter text"), (None, "no id")]
    found = merkle.edit_fingerprints(table(spark, rows)).collect()
    got = {r.doc_id: r for r in found}
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))  # by descending id, then text; no id comes last
    want = []
    for (i, t), (_, nxt) in zip(order, [*order[1:], order[0]], strict=True):
        t, nxt = t or "", nxt or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest()))
    assert sorted(map(repr, want)) == sorted(repr((r.doc_id, r.n_chars, r.edited_sha256)) for r in found)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in found)
    assert got[1].fingerprint == got[2].fingerprint != got[3].fingerprint
    assert merkle.edit_fingerprints(table(spark, [])).count() == 0


# --- 3 ----------------------------------------------------------------------------------------------------


def test_suffixes(spark):
    shared = words(60, 11)
    rows = odd_rows() + [(30 + k, " ".join(words(80, 100 + k) + shared + words(80, 200 + k))) for k in range(9)]
    got = {}
    for r in suffixes.deduplicate(table(spark, rows)).collect():
        got[r.doc_id] = r
    text = dict(rows)
    passage = " ".join(shared)
    assert passage in got[30].text and not got[30].removed
    for k in range(1, 9):
        r = got[30 + k]
        assert " ".join(words(80, 100 + k)) in r.text and " ".join(words(80, 200 + k)) in r.text and passage not in r.text
        (span,) = r.removed
        assert text[30 + k][span.start : span.end].split() == shared
    assert got[1].removed == [] and got[2].text == "" and got[10].removed == [] and got[7].removed == got[8].removed == []
    assert got[12].text == ""  # 70 words of document 1
    assert got[4].text is None
    assert suffixes.deduplicate(table(spark, [])).count() == 0


def test_suffixes_of_a_hot_passage(spark):
    """A third of all rows hold one passage, over many partitions."""
    shared = words(55, 13)
    rows = [(k, " ".join(words(20, 1000 + k) + (shared if k % 3 == 0 else []) + words(20, 3000 + k))) for k in range(600)]
    got = {r.doc_id: r for r in suffixes.deduplicate(table(spark, rows)).collect()}
    kept = [k for k in range(600) if " ".join(shared) in got[k].text]
    assert kept == [0] and all(bool(got[k].removed) == (k % 3 == 0 and k > 0) for k in range(600))


def test_suffixes_of_rows_that_share_an_id(spark):
    long = words(90, 17)
    text = " ".join(long)
    other = " ".join(words(40, 18) + long[10:75] + words(40, 19))
    rows = [(1, text), (2, text), (2, None), (2, "one two three"), (3, "a"), (4, text), (4, other), (4, other), (5, "one two three"), (None, text)]
    got = sorted((r.doc_id, r.text, r.n_words, r.n_removed) for r in suffixes.deduplicate(table(spark, rows)).collect() if r.text is not None)
    rest = " ".join(words(40, 18)) + "  " + " ".join(words(40, 19))
    assert got == sorted([(1, text, 90, 0), (2, "", 90, 90), (2, "one two three", 3, 0), (3, "a", 1, 0), (4, "", 90, 90), (4, rest, 145, 65), (4, rest, 145, 65), (5, "one two three", 3, 0)])


def repeated_words(rows, n=suffixes.MIN_WORDS):
    """Words in a window of n words that an earlier place holds, by document; rows are in order of id."""
    seen, out = set(), {}
    for i, t in rows:
        ws = t.split()
        out[i] = set()
        for p in range(len(ws) - n + 1):
            window = tuple(ws[p : p + n])
            if window in seen:
                out[i].update(range(p, p + n))
            seen.add(window)
    return out


def test_suffixes_of_a_passage_that_ends_in_boilerplate(spark):
    """The last words of each passage stand in 200 other documents, which sort between its two copies."""
    tails = {n: words(n, 500 + n) for n in (19, 25, 33, 41, 49)}
    passages = [words(55 - n, 600 + n) + tail for n, tail in tails.items()]
    texts = [words(20, 50_000 + 40 * k + n) + tail + words(20, 70_000 + 40 * k + n) for k in range(200) for n, tail in tails.items()]
    texts += [words(30, 20_000 + 2 * k + c) + p + words(30, 30_000 + 2 * k + c) for k, p in enumerate(passages) for c in range(2)]
    random.Random(8).shuffle(texts)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    want = repeated_words(rows)
    assert sum(len(w) for w in want.values()) >= 5 * 55  # and tails with a word more that happens to be equal
    text = dict(rows)
    got = {r.doc_id: sum((text[r.doc_id][s.start : s.end].split() for s in r.removed), []) for r in suffixes.deduplicate(table(spark, rows)).collect()}
    assert got == {i: [text[i].split()[p] for p in sorted(want[i])] for i in text}


def test_windows_of_one_gram_over_partitions():
    """A gram with more windows than a partition holds at once: what is handed over is compared with all that follows."""
    import numpy as np

    r = random.Random(12)
    keys = [r.randrange(1, 40) for _ in range(400)]
    found, outer = set(), []
    for part in range(4):
        sweep = suffixes._Sweep(50, held=5)
        for at in range(100 * part, 100 * part + 100, 10):
            doc = np.arange(at, at + 10)
            none = np.zeros(10, np.int64)
            sweep.add(np.arange(10), none, doc, none, none, np.array(keys[at : at + 10], np.uint64))
        sweep.end()
        found |= {int(d) for x in sweep.lost for d in x[0]}
        outer += [(int(k), int(d)) for x in sweep.outer for k, d in zip(x[0], x[1], strict=True)]
    outer.sort()
    last = suffixes._Sweep(50, held=5)
    key, doc = np.array([k for k, _ in outer], np.uint64), np.array([d for _, d in outer])
    last.add(np.arange(len(doc)), key.view(np.int64), doc, np.zeros(len(doc), np.int64), np.zeros(len(doc), np.int64), key)
    found |= {int(d) for x in last.lost for d in x[0]}
    assert found == {i for i, k in enumerate(keys) if k in keys[:i]}


# --- 4 ----------------------------------------------------------------------------------------------------


def least_capacity(sizes, shards_):
    def works(c):
        n, room = 1, c
        for s in sizes:
            if s > c:
                return False
            if s > room:
                n, room = n + 1, c
            room -= s
        return n <= shards_

    c = max(sizes)
    while not works(c):
        c += 1
    return c


def test_shards(spark):
    r = random.Random(3)
    rows = odd_rows() + [(100 + k, "z" * r.randint(0, 300)) for k in range(300)]
    got = shards.shard_by_bytes(table(spark, rows), shards=8, rows_each=40).collect()
    assert len(got) == len(rows)
    groups, first = {}, {}
    for i, t in rows:
        t = t or ""
        groups[t] = groups.get(t, 0) + len(t.encode()) + 1
        first[t] = min(first.get(t, i), i)
    capacity = least_capacity([groups[t] for t in sorted(groups, key=lambda t: (first[t], hashlib.md5(t.encode()).digest()))], 8)
    held, slots, crc = {}, {}, {}
    for x in got:
        held[x.shard] = held.get(x.shard, 0) + x.size
        slots.setdefault(x.shard, []).append(x.slot)
        crc.setdefault(x.text_crc32, set()).add(x.shard)
    assert max(held.values()) == capacity and all(sorted(s) == list(range(len(s))) for s in slots.values()) and all(len(s) == 1 for s in crc.values())
    assert shards.shard_by_bytes(table(spark, [])).count() == 0


# --- 5 ----------------------------------------------------------------------------------------------------


def test_mixing(spark):
    good, bad = words(40, 21), words(40, 22)
    r = random.Random(4)
    rows = [(k, " ".join(r.choices(good if k % 3 else bad, k=50))) for k in range(300)] + [(1000, None), (1001, "")]
    labels = spark.createDataFrame([(k, "good" if k % 3 else "bad") for k in range(0, 300, 2)], "doc_id long, domain string")
    out = mixing.mix(table(spark, rows), labels, {"good": 0.9, "bad": 0.1})
    got = out.collect()
    assert len(got) == 302
    assert all(x.domain == ("good" if x.doc_id % 3 else "bad") for x in got if x.doc_id < 300)
    mass = {d: sum(x.rate * x.tokens * x[f"p_{d}"] for x in got) for d in ("good", "bad")}
    assert abs(mass["good"] / sum(mass.values()) - 0.9) < 0.01 and all(x.rate >= 0 for x in got)
    assert mixing.mix(table(spark, []), labels, {"good": 0.9, "bad": 0.1}).count() == 0
    unlabelled = mixing.mix(table(spark, rows), labels.limit(0), {"good": 0.5, "bad": 0.5}).collect()
    assert all(abs(x.p_good - 0.5) < 1e-6 for x in unlabelled)


def test_mixing_against_plain_python(spark):
    """Rates by projected gradient with momentum, one document after the other, from the posteriors found."""
    r = random.Random(14)
    vocabulary = {"a": words(30, 41), "b": words(30, 42), "c": words(30, 43)}
    kind = {k: r.choice("aaabbc") for k in range(400)}
    rows = [(k, " ".join(r.choice(vocabulary[d] if r.random() < 0.3 else vocabulary["a"]) for _ in range(r.randint(0, 60)))) for k, d in kind.items()]
    rows += [(7, rows[8][1]), (1000, None), (None, rows[3][1])]
    label = {k: d for k, d in kind.items() if k % 2}
    weights = {"a": 0.5, "b": 0.45, "c": 0.05}
    got = mixing.mix(table(spark, rows), spark.createDataFrame(list(label.items()), "doc_id long, domain string"), weights).collect()
    assert sorted(repr((x.doc_id, x.tokens)) for x in got) == sorted(repr((i, len((t or "").split()))) for i, t in rows)
    p, t = [(x.p_a, x.p_b, x.p_c) for x in got], [x.tokens for x in got]
    n = [sum(a * b[d] for a, b in zip(t, p, strict=True)) for d in range(3)]
    budget = min(n[d] / w for d, w in enumerate(weights.values()) if w * 3 >= 1)
    goal = [min(w * budget, n[d]) for d, w in enumerate(weights.values())]
    rate, look, pace = [1.0] * len(got), [1.0] * len(got), 1.0
    mass = lambda at: [sum(a * b[d] * c for a, b, c in zip(t, p, at, strict=True)) for d in range(3)]
    for _ in range(80):
        if max(abs(m - g) / max(g, 0.001 * sum(n)) for m, g in zip(mass(rate), goal, strict=True)) < 1e-4:
            break
        miss = [(m - g) / x for m, g, x in zip(mass(look), goal, n, strict=True)]
        new = [max(0.0, c - sum(b[d] * miss[d] for d in range(3))) for b, c in zip(p, look, strict=True)]
        after = (1 + (1 + 4 * pace * pace) ** 0.5) / 2
        look, rate, pace = [x + (pace - 1) / after * (x - y) for x, y in zip(new, rate, strict=True)], new, after
    assert max(abs(x.rate - want) for x, want in zip(got, rate, strict=True)) < 2e-3
    assert max(abs(m - g) / max(g, 0.001 * sum(n)) for m, g in zip(mass([x.rate for x in got]), goal, strict=True)) < 1e-3
    assert all(abs(sum(x) - 1) < 1e-5 and min(x) >= 0 for x in p) and all(x.copies - 1 < x.rate < x.copies + 1 for x in got)


def test_domains_of_documents_that_were_not_trained_on(spark, sf_dir):
    """Held-out accuracy over the three domains, and of each of them."""
    docs = spark.read.parquet(f"{sf_dir.rpartition('sf')[0]}sf0.1/documents.parquet").select("doc_id", "text")
    labels = mixing.quality_domains(spark.read.parquet(f"{sf_dir.rpartition('sf')[0]}sf0.1/labels.parquet"))
    domains = list(mixing.WEIGHTS)
    model = mixing.fit_classifier(docs, labels.filter("doc_id % 3 <> 0"), domains)
    best = F.get(F.array(*[F.lit(d) for d in domains]), F.array_position("p", F.array_max("p")).cast("int") - 1)
    found = {(x[0], x[1]): x[2] for x in model.posteriors(docs, F.col("text")).join(labels.filter("doc_id % 3 = 0"), "doc_id").groupBy("domain", best.alias("best")).count().collect()}
    right = {d: found.get((d, d), 0) / sum(n for (a, _), n in found.items() if a == d) for d in domains}
    assert sum(n for (a, b), n in found.items() if a == b) >= 0.9 * sum(found.values()) and right["good"] >= 0.95 and right["plain"] >= 0.8 and right["toxic"] >= 0.55


@pytest.mark.parametrize("toxic", [0, 1])
def test_mixing_keeps_a_clean_corpus(spark, toxic):
    """0.1 % toxic documents, or none, where the weights ask for 1 %."""
    sets, r = {"good": words(40, 23), "plain": words(40, 24), "toxic": words(40, 25)}, random.Random(6)
    kind = {k: "toxic" if k < toxic else "plain" if k % 10 == 9 else "good" for k in range(1000)}
    docs = table(spark, [(k, " ".join(r.choices(sets[d], k=50))) for k, d in kind.items()])
    got = mixing.mix(docs, spark.createDataFrame(list(kind.items()), "doc_id long, domain string")).collect()
    n = {d: sum(v == d for v in kind.values()) for d in sets}
    copies = {d: sum(x.copies for x in got if kind[x.doc_id] == d) for d in sets}
    assert copies["good"] >= 0.98 * n["good"] and max(x.copies for x in got) <= 1
    assert copies["plain"] < 0.85 * n["plain"]  # 7 : 92 of the good ones


def test_mixing_targets():
    assert mixing.targets([930.0, 69.0, 1.0], [0.92, 0.07, 0.01]) == [930.0, 69.0, 1.0]
    assert set(mixing.unmet([930.0, 69.0, 1.0], [0.92, 0.07, 0.01])) == {1, 2}
    assert mixing.targets([10.0, 90.0], [0.5, 0.5]) == [10.0, 10.0] and mixing.unmet([10.0, 90.0], [0.5, 0.5]) == {}


# --- 6 ----------------------------------------------------------------------------------------------------


def test_packing(spark):
    rows = odd_rows()
    got = packing.best_fit(table(spark, rows)).collect()
    tokens = sorted(len((t or "").split()) for _, t in rows)
    total, bins, spans = {}, {}, {}
    for x in got:
        spans.setdefault(x.sequence_id, []).append((x.position, x.n_tokens))
        bins.setdefault(x.sequence_id, set()).add(x.capacity)
        total.setdefault(x.doc_id, []).append((x.piece_start, x.n_tokens))
    for s, placed in spans.items():
        (capacity,) = bins[s]
        at = 0
        for p, n in sorted(placed):
            assert p == at
            at += n
        smaller = [c for c in packing.LENGTHS if c < capacity]
        assert at <= capacity and (not smaller or at > max(smaller))
    assert sum(n for p in total.values() for _, n in p) == sum(tokens)
    assert packing.best_fit(table(spark, [])).count() == 0


def test_packing_takes_the_tightest_bin():
    placed = packing.pack([10, 6, 4, 5], lengths=[10], cost=lambda n: n)
    of = {p[0]: p[4] for p in placed}
    assert of[0] not in (of[1], of[2]) and of[1] == of[2]


def slow_pack(sizes, lengths, cost, floor):
    """One rule of the operator, each step by a search through everything."""
    longest, pieces = max(lengths), []
    for item, size in enumerate(sizes):
        k = 0
        while size > longest:
            pieces.append((longest, item, k))
            size, k = size - longest, k + 1
        pieces.append((size, item, k))
    pieces.sort(key=lambda p: (-p[0], p[1], p[2]))
    shortest = lambda held: min(n for n in lengths if n >= held)
    bins = []  # [length, [pieces]]
    for i, piece in enumerate(pieces):
        fits = [(b[0] - sum(p[0] for p in b[1]) - piece[0], k) for k, b in enumerate(bins) if b[0] - sum(p[0] for p in b[1]) >= piece[0]]
        if fits:
            bins[min(fits)[1]][1].append(piece)
            continue
        price = {}
        for n in lengths:
            if n >= piece[0]:
                held = piece[0]
                for p in pieces[i + 1 :]:
                    held += p[0] if held + p[0] <= n else 0
                price[n] = cost(shortest(held)) / max(1, held)
        least = min(price, key=lambda n: (price[n], n)) if floor is None else shortest(max(piece[0], floor))
        bins.append([least, [piece]])
    ends = [shortest(sum(q[0] for q in b[1])) for b in bins]
    return sum(map(cost, ends)), sorted((p[1], p[2], p[0], k, ends[k], b[0]) for k, b in enumerate(bins) for p in b[1])


def best_of(sizes, lengths, cost):
    return min((slow_pack(sizes, lengths, cost, f) for f in (None, *sorted(lengths))), key=lambda x: x[0])


@pytest.mark.parametrize("seed", range(12))
def test_packing_against_slow_search(seed):
    r = random.Random(seed)
    lengths = sorted(r.sample([8, 12, 16, 20, 32, 40, 64], 3))
    sizes = [r.choice([0, 1, 3, 5, 9, 11, 17, 25, 33, 70, 150]) for _ in range(r.randint(1, 60))]
    cost = r.choice([lambda n: n + 4, lambda n: n + n * n / 64 + 2, lambda n: n**0.5])
    placed = packing.pack(sizes, lengths, cost)
    assert sorted((p[0], p[1], p[3], p[4], p[5], p[6]) for p in placed) == best_of(sizes, lengths, cost)[1]


def total_cost(placed, cost):
    return sum(cost(c) for c in dict((p[4], p[5]) for p in placed).values())


def test_packing_chooses_among_lengths():
    """The choice is one for all bins, and costs never more than plain best fit or any one rule."""
    cost, lengths = packing.sequence_cost, list(packing.LENGTHS)
    assert {p[5] for p in packing.pack([300] * 30)} == {1024}
    grown = 0
    for seed in range(20):
        r = random.Random(seed)
        sizes = [r.choice([60, 300, 340, 500, 700, 900, 1300, 5000]) for _ in range(r.randint(1, 400))]
        placed = packing.pack(sizes)
        pieces = packing.pieces_of(sizes, lengths[-1])
        each = {f: packing.pack_by(pieces, lengths, cost, f)[0] for f in (None, *lengths)}
        assert total_cost(placed, cost) == pytest.approx(min(each.values())) and min(each.values()) <= each[lengths[0]]
        grown += min(each.values()) < each[lengths[0]]
    assert grown >= 15


def test_packing_of_a_table_opens_longer_bins(spark, sf_dir):
    got = packing.best_fit(spark.read.parquet(f"{sf_dir.rsplit('/', 1)[0]}/sf0.01/documents.parquet"))
    bins = {}
    for x in got.collect():
        bins.setdefault(x.sequence_id, [x.capacity, x.opened, 0, 0])
        bins[x.sequence_id][2] = max(bins[x.sequence_id][2], x.n_tokens)
        bins[x.sequence_id][3] += x.n_tokens
    least = lambda n: min(c for c in packing.LENGTHS if c >= n)
    assert sum(o > least(m) for _, o, m, _ in bins.values()) > 10  # opened for more than their first piece
    assert all(c == least(n) for c, _, _, n in bins.values())


def test_packing_shrinks_bins():
    seen = 0
    for seed in range(200):
        r = random.Random(seed)
        sizes, lengths, cost = [r.randint(1, 20) for _ in range(12)], [8, 14, 20], lambda n: n + 6
        placed = packing.pack(sizes, lengths, cost)
        seen += any(p[5] < p[6] for p in placed)
        assert sorted((p[0], p[1], p[3], p[4], p[5], p[6]) for p in placed) == best_of(sizes, lengths, cost)[1]
    assert seen > 5


def test_packing_of_an_id_that_a_third_of_all_rows_hold(spark):
    rows = [(7, "a b c")] * 300 + [(k, "d " * (k % 40)) for k in range(100, 700)]
    got = packing.best_fit(table(spark, rows), group=50).collect()
    assert sum(x.doc_id == 7 for x in got) == 300 and sum(x.n_tokens for x in got) == sum(len(t.split()) for _, t in rows)
    of = {}
    for x in got:
        of.setdefault(x.sequence_id % 18, set()).add(x.doc_id)
    assert sum(7 in ids for ids in of.values()) >= 3


# --- 7 ----------------------------------------------------------------------------------------------------


def deduplicated_lines(rows, unit, min_words):
    """id, text -> (clean text, spans), in order of (id, text hash given by the caller)."""
    import re

    def split(text):
        if unit == "sentence":
            text = re.sub(r"([.!?]) ", r"\1\n", text)
        return re.split(r"\n(?=[ \t\r]*\n)" if unit == "paragraph" else r"\n", text)

    seen, out = set(), []
    for i, text in rows:
        if text is None:
            out.append((i, None, [], []))
            continue
        spans, at = [], 0
        for part in split(text):
            body = " ".join(part.lower().split())
            spans.append((at, at + len(part), body, bool(body) and body in seen))
            seen.add(body)
            at += len(part) + 1
        real = [s for s in spans if s[2]]
        gone = set()
        for k in range(len(real)):  # the run around each repeated unit
            lo = hi = k
            while lo >= 0 and real[lo][3]:
                lo -= 1
            while hi < len(real) and real[hi][3]:
                hi += 1
            if real[k][3] and sum(len(s[2].split()) for s in real[lo + 1 : hi]) >= min_words:
                gone.add(real[k][:2])
        kept = [s for s in spans if s[:2] not in gone]
        clean = "".join((text[s[0] - 1] if n else "") + text[s[0] : s[1]] for n, s in enumerate(kept))
        out.append((i, clean, sorted(gone), sorted(s[:2] for s in real if s[3] and s[:2] not in gone)))
    return out


LINES = [
    (1, "A b\nx\n\nA  B\nz"), (2, "a b\nq"), (3, None), (4, ""), (5, "x\n\nx\n\nq"), (6, "\n\n"), (7, "long " * 30_000),
    (8, "One two three. Four five six! Seven eight nine? Ten\neleven."), (9, "zero. Four five six! Seven eight nine? More. One two three."), (10, "Four five six!\n\nSEVEN eight  nine?"),
]


@pytest.mark.parametrize("unit,min_words", [("line", 1), ("paragraph", 1), ("sentence", 1), ("sentence", 5), ("line", 3)])
def test_lines(spark, unit, min_words):
    got = sorted((r.doc_id, r.text, [(s.start, s.end) for s in r.removed], [(s.start, s.end) for s in r.spared]) for r in lines.deduplicate(table(spark, LINES), unit=unit, min_words=min_words).collect())
    assert got == deduplicated_lines(LINES, unit, min_words)
    assert lines.deduplicate(table(spark, [])).count() == 0


def test_lines_of_rows_that_share_an_id(spark):
    rows = [(1, "a b\nc d"), (2, "x y\nc d"), (2, "p q\nr s"), (2, "p q\nr s"), (None, "a b")]
    got = sorted((r.doc_id, r.text) for r in lines.deduplicate(table(spark, rows)).collect())
    assert got == [(1, "a b\nc d"), (2, "p q\nr s"), (2, "p q\nr s"), (2, "x y")]


# --- 8 ----------------------------------------------------------------------------------------------------


def test_flac_round_trip(spark):
    rows = [*odd_rows(), (None, "no id"), (1, "another text of one")]
    got = flac.text_media(table(spark, rows)).collect()
    want = []
    for i, t in rows:
        raw = (t or "").encode()
        payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        want.append((i, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), None))
    assert sorted(map(repr, ((x.doc_id, x.n_bytes, x.payload_bytes, x.payload_sha256, x.tail_crc32, x.error) for x in got))) == sorted(map(repr, want))
    assert flac.text_media(table(spark, [])).count() == 0


def test_flac_blocks_and_damage(spark):
    data = bytes(random.Random(1).choices(range(60, 90), k=5000))
    media = flac.encode([data])[0]
    broken = bytearray(media)
    broken[-40] ^= 0x55
    df = spark.createDataFrame([(1, 0, media), (2, 0, bytes(broken)), (3, 0, None), (4, 0, b"no flac")], "doc_id long, n_bytes long, media binary")
    (blocks,) = flac.store([df], ["doc_id", "n_bytes"])
    got = {x.doc_id: x for x in blocks.collect()}
    whole = [(b.sample_offset, b.samples) for b in got[1].blocks]
    assert sum(n for _, n in whole) == 5000 and all(a + n == b for (a, n), (b, _) in zip(whole, whole[1:], strict=False))
    assert all(got[i].error for i in (2, 3, 4)) and not got[1].error and len(got[2].blocks) == len(whole) - 1 and got[3].blocks == got[4].blocks == []
    for start, n in ((0, 10), (1020, 10), (1000, 3000), (4990, 100), (9000, 5)):
        sought = {x.doc_id: bytes(x.pcm) for x in blocks.select("doc_id", flac.seek(blocks, F.lit(start), F.lit(n)).alias("pcm")).collect() if x.pcm is not None}
        import numpy as np

        assert flac.payload(np.frombuffer(sought[1], np.int8)) == data[start : start + n]
    told = {x.doc_id: x for x in flac.media_features(blocks).collect()}
    assert told[1].payload_sha256 == hashlib.sha256(data).hexdigest() and told[1].media_bytes == len(media)
    assert all(told[i].error and told[i].payload_bytes is None and told[i].payload_sha256 is None and told[i].feature is None for i in (2, 3, 4))


class BitWriter:
    def __init__(self):
        self.bits = []

    def put(self, value, width):
        self.bits += [(value >> (width - 1 - k)) & 1 for k in range(width)]

    def rice(self, value, k):
        u = value << 1 if value >= 0 else (-value << 1) - 1
        self.bits += [0] * (u >> k) + [1]
        self.put(u & ((1 << k) - 1), k)

    def data(self):
        self.bits += [0] * (-len(self.bits) % 8)
        return bytes(int("".join(map(str, self.bits[i : i + 8])), 2) for i in range(0, len(self.bits), 8))


def crc(data, poly, width):
    c, top = 0, 1 << (width - 1)
    for b in data:
        c ^= b << (width - 8)
        for _ in range(8):
            c = ((c << 1) ^ (poly if c & top else 0)) & ((1 << width) - 1)
    return c


def hand_built(bits, assigned, subframes, n, channels):
    """A stream of one frame; each subframe is a function that writes itself."""
    w = BitWriter()
    w.put(0xFFF8, 16), w.put(7 << 4 | 0, 8), w.put(assigned << 4 | {8: 1, 16: 4, 24: 6}[bits] << 1, 8), w.put(0, 8), w.put(n - 1, 16)
    head = w.data()
    w.put(crc(head, 0x07, 8), 8)
    for s in subframes:
        s(w)
    frame = w.data()
    frame += crc(frame, 0x8005, 16).to_bytes(2, "big")
    info = n.to_bytes(2, "big") * 2 + bytes(6) + (44100 << 44 | (channels - 1) << 41 | (bits - 1) << 36 | n).to_bytes(8, "big") + bytes(16)
    return b"fLaC" + b"\x80" + len(info).to_bytes(3, "big") + info + frame


def predicted(x, depth, coef, shift, kind, k, precision=None, escape=None):
    """Writes a fixed or LPC subframe with one partition: Rice parameter ``k`` or raw residuals of ``escape`` bits."""

    def write(w):
        order = len(coef)
        w.put(0, 1), w.put(kind, 6), w.put(0, 1)
        for v in x[:order]:
            w.put(v & ((1 << depth) - 1), depth)
        if precision:
            w.put(precision - 1, 4), w.put(shift, 5)
            for c in coef:
                w.put(c & ((1 << precision) - 1), precision)
        w.put(0, 2), w.put(0, 4), w.put(15 if escape else k, 4)
        if escape:
            w.put(escape, 5)
        for t in range(order, len(x)):
            r = x[t] - (sum(c * x[t - 1 - j] for j, c in enumerate(coef)) >> shift)
            w.put(r & ((1 << escape) - 1), escape) if escape else w.rice(r, k)

    return write


def test_flac_decoder_on_hand_built_streams():
    r, n = random.Random(9), 40
    wave = lambda top: [int(top * ((t * 7919 % 97) / 97 - 0.5)) for t in range(n)]
    left, right = wave(3000), [v + r.randint(-50, 50) for v in wave(3000)]
    side = [a - b for a, b in zip(left, right, strict=True)]
    mid = [(a + b) >> 1 for a, b in zip(left, right, strict=True)]
    fixed4 = (4, -6, 4, -1)
    lpc12 = [r.randint(-300, 300) for _ in range(12)]
    streams = [
        (hand_built(16, 1, [predicted(left, 16, fixed4, 0, 12, 10), predicted(right, 16, (2, -1), 0, 10, 9)], n, 2), [left, right]),
        (hand_built(16, 8, [predicted(left, 16, (1,), 0, 9, 9), predicted(side, 17, (), 0, 8, 5)], n, 2), [left, right]),
        (hand_built(16, 9, [predicted(side, 17, (), 0, 8, 5), predicted(right, 16, (1,), 0, 9, 9)], n, 2), [left, right]),
        (hand_built(16, 10, [predicted(mid, 16, lpc12, 9, 31 + 12, 10, precision=12), predicted(side, 17, (1,), 0, 9, 5)], n, 2), [left, right]),
        (hand_built(24, 0, [predicted(wave(4_000_000), 24, lpc12, 10, 31 + 12, 14, precision=12)], n, 1), [wave(4_000_000)]),
        (hand_built(16, 0, [predicted(left, 16, (1,), 0, 9, 0, escape=14)], n, 1), [left]),
        (hand_built(8, 0, [lambda w: (w.put(0, 8), w.put(-5 & 255, 8))], n, 1), [[-5] * n]),
        (hand_built(8, 0, [lambda w: (w.put(2, 8), [w.put(v & 255, 8) for v in wave(200)])], n, 1), [wave(200)]),
        (hand_built(16, 0, [lambda w: (w.put(3, 8), w.put(0b01, 2), [w.put(v & 0x3FFF, 14) for v in wave(900)])], n, 1), [[v * 4 for v in wave(900)]]),
    ]
    for found, (_, want) in zip(flac.decode([s for s, _ in streams]), streams, strict=True):
        assert found.error is None
        (block,) = found.blocks
        assert block.T.tolist() == want


# --- 9 ----------------------------------------------------------------------------------------------------


def test_language(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out and lang is not null").collect()
    right = sum(r.lang == r.lang_pred for r in got)
    assert len(got) > 20 and right >= 0.9 * len(got)
    odd = {r.doc_id: r for r in langid.predict(table(spark, [(1, None), (2, ""), (3, "12 34 --"), (4, "the and of " * 30_000)]), langid.fit(docs)).collect()}
    assert [odd[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and odd[4].lang_pred != "und" and 0 <= odd[4].score <= 1
    assert langid.identify(docs.limit(0)).count() == 0


def chain_posteriors(emit, trans, start):
    """By the sum over all ways to label the words."""
    import itertools

    import numpy as np

    n, k = emit.shape
    out, total = np.zeros((n, k)), 0.0
    for path in itertools.product(range(k), repeat=n):
        weight = np.exp(start[path[0]] + sum(emit[t, y] for t, y in enumerate(path)) + sum(trans[a, b] for a, b in zip(path, path[1:], strict=False)))
        total += weight
        for t, y in enumerate(path):
            out[t, y] += weight
    return out / total, np.log(total)


def test_forward_backward_against_all_labellings():
    import numpy as np

    r = np.random.default_rng(3)
    trans, start = r.normal(size=(3, 3)), r.normal(size=3)
    size = np.array([7, 5, 1])
    emit = r.normal(size=(7, 3, 3))
    post, z, pairs = langid.forward_backward(emit, size, trans, np.exp(start))
    for c, n in enumerate(size):
        want, total = chain_posteriors(emit[:n, c], trans, start)
        assert np.allclose(post[:n, c], want) and np.isclose(z[c], total)
    step = 1e-5  # the expected transitions are the derivative of the normalisers
    for a in range(3):
        for b in range(3):
            moved = trans.copy()
            moved[a, b] += step
            up = langid.forward_backward(emit, size, moved, np.exp(start))[1].sum()
            assert np.isclose((up - z.sum()) / step, pairs[a, b], atol=1e-3)


def test_pieces_of_a_text_are_one_chain(monkeypatch):
    """The same posteriors whether a text is one piece or many, and whether its bytes are taken at once or in parts."""
    import numpy as np

    r = np.random.default_rng(5)
    model = langid._train(["x", "y", "z"], [(k % 3, " ".join(words(20, 600 + k)).translate(str.maketrans("abc", "abc" if k % 3 else "qrs")).encode()) for k in range(60)], 10, 1)
    model.trans[:] = r.normal(size=(3, 3))
    model.start[:] = r.normal(size=3)
    blobs = [" ".join(words(n, 700 + n)).encode() for n in (1, 3, 64, 65, 200, 0, 129, 700)]
    got = langid.word_posteriors(model, langid.Features(), blobs)
    monkeypatch.setattr(langid, "CHAIN", 10_000)
    whole = langid.word_posteriors(model, langid.Features(), blobs)
    assert np.allclose(got[3], whole[3], atol=1e-4) and (got[2] == whole[2]).all()
    start, end, emit = langid._emissions(model, langid.Features(), blobs[-1])
    parts = langid._emissions(model, langid.Features(), blobs[-1], 100)
    assert (parts[0] == start).all() and (parts[1] == end).all() and np.allclose(parts[2], emit, atol=1e-5)


def test_gradient_is_that_of_the_likelihood():
    """The step of training, expected against seen features, by differences of the log-likelihood."""
    import numpy as np

    spans = [(k % 2, " ".join(words(4, 800 + k)).encode()) for k in range(20)]
    features, k = langid.Features(), 2
    start, _, hashes, grams, bounds, own = features(b"\n".join(b for _, b in spans), None)
    first = np.searchsorted(start, np.cumsum([0, *(len(b) + 1 for _, b in spans)]))
    r = np.random.default_rng(2)
    model = langid.Model(["a", "b"], r.normal(scale=0.1, size=(1 << langid.BITS, k)), np.zeros(1 << langid.LEXICON_BITS, np.uint64), r.normal(size=(k, k)), r.normal(size=k))
    index = first[:-1] + np.arange(4)[:, None]
    size = np.full(20, 4)
    gold = np.array([y for y, _ in spans])

    def likelihood():
        emit = langid.emissions(model, grams, bounds, own)[index]
        _, z, _ = langid.forward_backward(emit, size, model.trans, np.exp(model.start))
        path = emit[:, np.arange(20), gold].sum() + 3 * model.trans[gold, gold].sum() + model.start[gold].sum()
        return path - z.sum()

    post, _, pairs = langid.forward_backward(langid.emissions(model, grams, bounds, own)[index], size, model.trans, np.exp(model.start))
    base, step = likelihood(), 1e-5
    slot = int(own[0][index[2, 3]])
    holds = (own[0][index] == slot).astype(float) + (own[1][index] == slot)  # other templates have other slots
    for lang in range(k):
        want = (holds * ((gold == lang) - post[:, :, lang])).sum()
        model.weights[slot, lang] += step
        assert np.isclose((likelihood() - base) / step, want, atol=1e-2)
        model.weights[slot, lang] -= step
    wanted = np.diag(np.bincount(gold, minlength=k) * 3)
    model.trans[0, 1] += step
    assert np.isclose((likelihood() - base) / step, (wanted - pairs)[0, 1], atol=1e-2)


def test_words_of_mixed_text_are_labelled(spark, sf_dir):
    """A text that changes its language: nearly every word gets the language of its part, with offsets into the text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("text is not null and n_chars between 300 and 3000")
    model = langid.fit(docs)
    part = {r.lang: r.text for r in docs.filter("lang is not null").orderBy("doc_id").limit(150).collect()}
    a, b = sorted(part)[:2]
    text = f"{part[a]}\n{part[b]}"
    got = sorted(langid.label_words(table(spark, [(1, text), (2, None), (3, "12 - 34"), (None, text)]), model).collect(), key=lambda r: r.word)
    blob = text.encode()
    cut = len(part[a].encode())
    assert {r.doc_id for r in got} == {1} and [r.word for r in got] == list(range(len(got))) and all(0 <= r.probability <= 1 for r in got)
    assert all(blob[r.start : r.end].strip() == blob[r.start : r.end] != b"" for r in got)
    right = [r.lang == (a if r.end <= cut else b) for r in got]
    assert sum(right) >= 0.9 * len(right)


# --- 10 ---------------------------------------------------------------------------------------------------


def test_licenses(spark):
    notice = licenses.TEMPLATES["mit-grant"]
    part = " ".join(notice.split()[:-3])
    rows = [(1, "aa bb " + notice.upper() + " cc"), (2, None), (3, ""), (4, "MIT"), (5, " ".join(words(3000, 5)) + " " + part), (6, " ".join(notice.split()[:8])), (7, " ".join(words(20_000, 6)))]
    got = {(r.doc_id, r.license): r.containment for r in licenses.scan(table(spark, rows)).collect()}

    def held(text, template):
        t, x = licenses.template_words(template), licenses.template_words(text or "")
        grams = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
        return len(grams(t) & grams(x)) / len(grams(t))

    want = {(i, k) for i, x in rows for k, t in licenses.TEMPLATES.items() if held(x, t) >= 0.75}
    assert set(got) == want and (1, "mit-grant") in want and (5, "mit-grant") in want
    assert licenses.scan(table(spark, [])).count() == 0


def test_license_texts_and_short_templates(spark):
    """A whole license text with a fifth of it cut off, one with more cut off, and templates under five words."""
    text = licenses.TEMPLATES["mit-text"].split()
    rows = [
        (1, " ".join(words(50, 7) + text[: len(text) * 85 // 100] + words(50, 8))), (2, " ".join(text[: len(text) // 2])), (3, "x y Public-Domain z. public domain"),
        (None, " ".join(text)), (5, "public"), (6, None), (7, "public domain"), (7, "a public domain"),
    ]
    got = {(r.doc_id, r.license): (r.containment, r.n_shingles, r.first_word) for r in licenses.scan(table(spark, rows), licenses.TEMPLATES | {"pd": "Public Domain", "none": "..."}).collect()}
    assert {k for k in got if k[1] == "mit-text"} == {(1, "mit-text")} and 0.75 <= got[1, "mit-text"][0] < 0.9
    assert {k: v for k, v in got.items() if k[1] == "pd"} == {(3, "pd"): (1.0, 1, 2), (7, "pd"): (1.0, 1, 0)}
    only = licenses.scan(table(spark, rows), {"pd": "Public Domain"}).collect()
    assert {r.doc_id for r in only} == {3, 7} and licenses.scan(table(spark, rows), {}).count() == 0 and licenses.scan(table(spark, rows), {"none": "--"}).count() == 0


def test_telling_words_leave_too_little_for_a_match():
    for threshold in (0.5, 0.75, 1.0):
        tell = set(licenses.telling(licenses.TEMPLATES, threshold))
        for t in licenses.TEMPLATES.values():
            w = licenses.template_words(t)
            grams = {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
            assert sum(not tell & set(g) for g in grams) < threshold * len(grams)


def torn(template, k, gap, seed):
    """A notice with ``gap`` words inserted at k places, and its containment."""
    w = licenses.template_words(template)
    cuts = [round(len(w) * (i + 1) / (k + 1)) for i in range(k)]
    out = []
    for i, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(w)], strict=True)):
        out += w[a:b] + (words(gap, 100 * seed + i) if i < k else [])
    grams = lambda x: {tuple(x[i : i + 5]) for i in range(len(x) - 4)}
    return out, round(len(grams(w) & grams(out)) / len(grams(w)), 6)


def test_licenses_with_inserted_words(spark):
    """One to many words, at one place or several, at many alignments to the windows: nothing is lost."""
    rows, want, i = [], {}, 0
    for name, template in licenses.TEMPLATES.items():
        for k in (1, 2, 5):
            for gap in (1, 5, 12, 20, 150, 3000):
                for lead in (0, 3, 17):
                    found, c = torn(template, k, gap, i)
                    rows.append((i, " ".join(words(lead, i) + found + words(60, i + 7))))
                    if c >= 0.75:
                        want[i, name] = c
                    i += 1
    got = {(r.doc_id, r.license): r.containment for r in licenses.scan(table(spark, rows)).collect()}
    grams = lambda x: {tuple(x[j : j + 5]) for j in range(len(x) - 4)}
    shingles = {k: grams(licenses.template_words(t)) for k, t in licenses.TEMPLATES.items()}
    for j, text in rows:  # notices that hold another one
        have = grams(text.split())
        want |= {(j, k): round(len(s & have) / len(s), 6) for k, s in shingles.items() if len(s & have) / len(s) >= 0.75}
    assert got == want and len(want) > 300
