"""Spelling variants, web archives and fill-in-middle documents against brute force on small tables with every odd case."""

import gzip
import hashlib
import io
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from gridspark.llm import infill, spelling, warc
from gridspark.llm.queries import QUERIES

# --- 11 -----------------------------------------------------------------------------------------------------


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long_ = sorted((a, b), key=len)
    return len(long_) == len(short) + 1 and any(long_[:i] + long_[i + 1 :] == short for i in range(len(long_)))


def grouped(counts, ratio=5):
    """(n_near, form, root) of each word, all pairs compared."""
    found = {}
    for w, n in counts.items():
        others = [v for v in counts if near(w, v)]
        best = min(others, key=lambda v: (-counts[v], v.encode()), default=None)
        found[w] = (len(others), best if best is not None and counts[best] >= ratio * n else None)
    out = {}
    for w in counts:
        root = w
        while found[root][1] is not None:
            root = found[root][1]
        out[w] = (counts[w], *found[w], counts[found[w][1]] if found[w][1] else None, root)
    return out


def vocabulary(seed, letters, n):
    r = random.Random(seed)
    words = {"".join(r.choice(letters) for _ in range(r.randint(1, 7))) for _ in range(n)}
    for w in list(words)[: n // 2]:
        i = r.randrange(len(w) + 1)
        words |= {w[:i] + r.choice(letters) + w[i:], w[:i] + w[i + 1 :], w[:i] + r.choice(letters) + w[i + 1 :]}
    return {w: r.choice([1, 1, 2, 5, 10, 11, 60, 300]) for w in sorted(words - {""})}


@pytest.mark.parametrize("letters,n", [("ab", 80), ("abcdefgh", 150), ("aé漢😀", 90)])
def test_variants(spark, letters, n):
    counts = vocabulary(n, letters, n)
    df = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3)
    got = {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in spelling.group_variants(df).collect()}
    assert got == grouped(counts) and any(v[2] for v in got.values())


def test_top_nodes_are_joined_too(spark, monkeypatch):
    counts = vocabulary(4, "abc", 120)
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    want = {(a, b) for a in counts for b in counts if near(a, b)}
    for limit in (0, 12):  # words below a node over which its heavy child is sent to all
        monkeypatch.setattr(spelling, "MANY", limit)
        assert {(r.a, r.b) for r in spelling.one_edit_pairs(df.select("word")).collect()} == want


def test_few_light_edges(spark):
    words = ["".join(p) for p in itertools.product("abcd", repeat=5)] + ["aab" * 60 + c for c in "xyz"]
    df = spark.createDataFrame([(w,) for w in words], "word string")
    most = spelling.light_edges(df).groupBy("word").count().agg(F.max("count")).first()[0]
    assert most <= len(words).bit_length()


def test_words_of_documents(spark):
    long_ = "Z" * 300_000
    rows = [(1, "Straße straße STRAßE, Åcute×tail"), (2, None), (3, ""), (None, "nullid nullid"), (4, f"{long_} {long_}"), (4, "abcdef " * 500), (4, "abcdef " * 500), (5, "12 345 --")]
    df = spark.createDataFrame([(i, t, 1, "x", "y") for i, t in rows], "doc_id long, text string, n long, word string, run string").repartition(3)
    want = {}
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            run = run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run
            want[run] = want.get(run, 0) + 1
    spelt = spelling.runs(df).select(spelling.misspelt(F.col("doc_id"), F.col("run")).alias("word"))
    counts = spelling.word_counts(spelt, min_chars=5, min_count=2)
    got = {r.word: r.n for r in counts.collect()}
    assert got == {w: n for w, n in want.items() if len(w) >= 5 and n >= 2} and long_.lower() in got
    assert spelling.group_variants(counts).count() == len(got)
    assert spelling.group_variants(counts.limit(0)).count() == 0
    with pytest.raises(ValueError):
        spelling.group_variants(counts, ratio=1)


def test_deleted_letters_come_back(spark):
    """Some run of the letters below is misspelt by its checksum; the misspelling finds its form."""
    hit = next(i for i in itertools.count() if zlib.crc32(f"{i}:gravity".encode()) % 199 == 0)
    rows = [(i, "gravity") for i in range(hit + 1, hit + 200)] + [(hit, "gravity " * 5)]
    spelt = spelling.runs(spark.createDataFrame(rows, "doc_id long, text string")).select(spelling.misspelt(F.col("doc_id"), F.col("run")).alias("word"))
    got = {r.word: (r.n, r.form, r.root) for r in spelling.group_variants(spelling.word_counts(spelt)).collect()}
    wrong = next(w for w in got if w != "gravity")
    assert got[wrong][1:] == ("gravity", "gravity") and got["gravity"][1] is None and len(wrong) == 6


# --- 12 -----------------------------------------------------------------------------------------------------


def pages():
    body = "<p>" + "word " * 40 + "</p>"
    odd = "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" * 3
    return [
        (5, "http://A.example.com/x?q=1#f", body), (3, "https://b.example.com", body), (9, "http://a.example.com/x?q=1", body), (9, "http://a.example.com/x?q=1", body),
        (3, "https://b.example.com", body), (None, "http://a.example.com/x?q=1", body), (None, "not a url", "lone " * 30), (None, "not a url", "lone " * 30), (1, None, None), (2, "http://c.d/", ""), (4, "http://c.d/ a\r\nb", "short"),
        (6, "http://c.d", "short"), (7, "http://c.d/", odd), (8, "http://c.d/", odd), (10, "http://ü.d/ß", "漢字😀" * 100), (11, "http://big.d/", "<b>x</b>" * 400_000), (12, "http://c.d/", "漢" * 33), (13, "http://c.d/", "漢" * 33 + "x"), (14, "http://c.d/", "漢" * 33 + "x"),
    ]


def page_table(spark, rows):
    return spark.createDataFrame([(i, u, h, 1, "k", "r", 7) for i, u, h in rows], "page_id long, url string, html string, first long, kind string, record string, run long").repartition(4)


def expected(rows):
    out = []
    for i, _, h in rows:
        data = (h or "").encode()
        same = [j for j, _, g in rows if (g or "") == (h or "") and j is not None]
        first = min(same) if same and len(data) >= 100 else None
        later = first is not None and (i is None or i > first)
        out.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if later else "response", first if later else None))
    return sorted(out, key=repr)


def test_archives(spark):
    rows = pages()
    archives = warc.write_archives(warc.captures(page_table(spark, rows)), archive_bytes=600)
    got = warc.history(warc.read_archives(archives)).collect()
    assert sorted(((r.id, r.payload_bytes, r.digest, r.kind, r.refers_to) for r in got), key=repr) == expected(rows)
    assert len({(r.archive, r.offset) for r in got}) == len(rows) and len({r.archive for r in got}) > 4
    ordered = sorted(got, key=lambda r: r.position)
    assert [r.position for r in ordered] == list(range(1, len(rows) + 1))
    keys = [(r.url_key, r.time, -1 if r.id is None else r.id) for r in ordered]
    assert keys == sorted(keys) and "com,example,a)/x?q=1" in {k[0] for k in keys} and "d,c)/%20a%0D%0Ab" in {k[0] for k in keys}
    seen = {}
    for r in ordered:
        seen[r.url_key] = seen.get(r.url_key, 0) + 1
        assert r.capture_no == seen[r.url_key]
    assert warc.history(warc.read_archives(warc.write_archives(warc.captures(page_table(spark, rows).limit(0))))).count() == 0


def test_exported_files(spark, tmp_path):
    rows = pages()
    archives = warc.write_archives(warc.captures(page_table(spark, rows)), archive_bytes=2000)
    warc.export(archives, str(tmp_path / "out"))
    index = {(r.archive, r.offset): r.length for r in warc.read_archives(archives).collect()}
    names = sorted(p.name.removeprefix("archive=") for p in (tmp_path / "out").glob("archive=*"))
    assert names == sorted({a for a, _ in index})
    for name in names:
        (path,) = (tmp_path / "out" / f"archive={name}").glob("part-*")
        data = path.read_bytes()
        whole = gzip.GzipFile(fileobj=io.BytesIO(data)).read()
        assert whole.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n") and whole.endswith(b"\r\n\r\n")
        for (a, at), size in index.items():
            if a == name:  # a record is read by its offset
                heads, _ = warc.parse(data[at : at + size])
                assert heads["warc-type"] in ("response", "revisit")


def test_damaged_archives(spark):
    archives = warc.write_archives(warc.captures(page_table(spark, [(1, "http://a.b/", "x" * 200)])))
    good = [(r.archive, r.offset, bytes(r.member)) for r in archives.collect()]
    kind = "archive string, offset long, member binary"
    (name, at, packed) = max(good, key=lambda r: r[1])
    flipped = bytearray(packed)
    flipped[len(packed) // 2] ^= 1
    heads, block = warc.parse(packed)
    other = warc.member("response", [(k.title(), v) for k, v in heads.items() if k not in ("warc-type", "content-length")], block.replace(b"xxx", b"xyx", 1))
    for bad in (packed[:-5], packed + packed, bytes(flipped), other):
        with pytest.raises(Exception):
            warc.read_archives(spark.createDataFrame([(name, at, bad)], kind)).collect()
    orphan = warc.member("revisit", [("WARC-Record-ID", "<urn:uuid:1>"), ("WARC-Date", "2024-01-01T00:00:00Z"), ("WARC-Payload-Digest", "sha256:00"), ("WARC-Refers-To", "<urn:uuid:2>")], b"HTTP/1.1 200 OK\r\nContent-Length: 5\r\n\r\n")
    with pytest.raises(Exception, match="no payload for"):
        warc.read_archives(spark.createDataFrame([("a", 0, orphan)], kind)).collect()


def test_loser_tree():
    r = random.Random(1)
    for k in [0, 1, 2, 3, 5, 8, 13]:
        runs = [sorted((r.randint(0, 20), i) for _ in range(r.choice([0, 1, 7, 40]))) for i in range(k)]
        assert list(warc.merge(runs)) == sorted(x for run in runs for x in run)


# --- 13 -----------------------------------------------------------------------------------------------------


def infilled(i, t):
    t = t or ""
    digest = hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", t)
    n = len(units)
    form = "plain" if not t or any(s in t for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50 else "spm" if h4 % 100 < 80 else "psm"
    if form == "plain":
        return (i, n, form, None, None, t)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    return (i, n, form, len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}" if form == "psm" else f"<S>{suf}<P>{pre}<M>{mid}")


def test_fill_in_middle(spark):
    r = random.Random(2)
    odd = [None, "", " ", " \t\n ", "one", "  lead and trail \n", "<P> in it", "a <S", "S> < <S <M x", "漢字 😀 ü ß x y", "w " * 30_000, "same same"]
    rows = [(i, odd[i % len(odd)] if i % 3 else " ".join("".join(r.choice("ab<>PSM ") for _ in range(5)) for _ in range(r.randint(1, 30)))) for i in range(240)]
    rows += [(None, "no id here " * 3), (7, "same id other text"), *[(11, "again and again")] * 5, (-3, "negative id")]
    df = spark.createDataFrame([(i, t, 1, 2, "n") for i, t in rows], "doc_id long, text string, n long, key long, form string").repartition(5)
    out = infill.fill_in_middle(df).withColumn("back", infill.restore(F.col("output"), F.col("form"))).collect()
    got = sorted(((x.doc_id, x.n, x.form, x.prefix_chars, x.middle_chars, x.output) for x in out), key=repr)
    assert got == sorted((infilled(i, t) for i, t in rows), key=repr)
    assert {x.form for x in out} == {"plain", "psm", "spm"}
    assert sorted(x.back for x in out) == sorted(t or "" for _, t in rows)
    assert infill.fill_in_middle(df.limit(0)).count() == 0
    other = infill.fill_in_middle(df, rate=100, spm=0, seed=7).groupBy("form").count().collect()
    assert {x.form for x in other} == {"plain", "psm"}


@pytest.mark.parametrize("name", ["op11_spelling_groups", "op12_warc_history", "op13_fill_in_middle"])
def test_columns(spark, sf_dir, name):
    want = {
        "op11_spelling_groups": [("word", "string"), ("form", "string"), ("root", "string"), ("n", "bigint"), ("n_near", "bigint"), ("form_n", "bigint")],
        "op12_warc_history": [("page_id", "bigint"), ("payload_bytes", "bigint"), ("payload_digest", "string"), ("record_type", "string"), ("refers_to", "bigint"), ("url_key", "string"), ("time", "string"), ("position", "bigint"), ("capture_no", "bigint")],
        "op13_fill_in_middle": [("doc_id", "bigint"), ("n", "bigint"), ("form", "string"), ("prefix_chars", "bigint"), ("middle_chars", "bigint"), ("output_sha256", "string"), ("restored_sha256", "string")],
    }
    assert QUERIES[name](spark, sf_dir).dtypes == want[name]
