"""WARC archives, the Merkle manifest and collocations against brute force."""

import gzip
import hashlib
import io
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import collocations, manifest, warc
from tessera.llm.text import ship
from tessera.session import checkpoint_dir


def rows(df):
    return [r.asDict() for r in df.collect()]


# archives

def _blob(seed=1):
    rng = random.Random(seed)
    made = [warc.member(i, f"http://x/{i}\r\nWARC-Type: no", rng.randbytes(rng.choice([0, 10, 5000])), None if i % 3 else 7)
            for i in range(60)]
    at = np.cumsum([0] + [len(m) for m in made]).tolist()
    return b"".join(made), list(zip(at[:-1], at[1:], strict=True))


@pytest.mark.parametrize("step", [1, 7, 100, 3333, 10**7])
def test_every_record_is_owned_by_one_range(step):
    blob, want = _blob()
    got = []
    for start in range(0, len(blob), step):
        got += [(a, b) for a, b, _ in warc.owned(io.BytesIO(blob), len(blob), start, min(start + step, len(blob)))]
    assert got == want


def test_members_are_plain_gzip_and_headers_cannot_be_forged():
    blob, spans = _blob()
    plain = gzip.decompress(blob)
    assert plain.count(b"WARC/1.1\r\n") == 60 and b"\r\nWARC-Type: no" not in plain
    record = warc.parse(gzip.decompress(blob[slice(*spans[1])]))
    assert record["target_uri"] == "http://x/1%0D%0AWARC-Type:%20no" and record["intact"]


def test_damage_padding_and_foreign_members_are_passed_over():
    blob, spans = _blob(2)
    broken = bytearray(blob)
    broken[spans[5][0] + 30] ^= 0xFF
    mixed = b"\x00" * 9 + bytes(broken) + gzip.compress(b"no record") + warc.MAGIC + blob[:spans[0][1] // 2]
    got = [a - 9 for a, _, _ in warc.owned(io.BytesIO(mixed), len(mixed), 0, len(mixed))]
    assert [a for a, _ in spans if a != spans[5][0]] == [a for a in got if a < len(blob)]
    assert not [a for a in got if a >= len(blob)]


def _want_pages(table):
    payloads = [(i, (h or "").encode()) for i, _, h in table]
    first = {}
    for i, p in payloads:
        if i is not None:
            first[p] = min(first.get(p, i), i)
    out = []
    for i, p in payloads:
        f = first.get(p)
        out.append((i, len(p), warc.digest(p), "response" if f in (None, i) else "revisit", None if f in (None, i) else f))
    return sorted(out, key=str)


def test_pages_come_back(spark):
    ship(spark)
    table = [(5, "u5", "<p>same</p>"), (3, "u3", "<p>same</p>"), (9, None, "<p>same</p>"), (1, "a\r\nb", None), (2, "u2", ""),
             (4, "u4", "é😀" * 3000), (4, "u4", "é😀" * 3000), (None, "n", "<p>same</p>"), (None, "n", "alone"), (-8, "u", "x" * 400_000)]
    pages = spark.createDataFrame([(*r, 1, "z", 2) for r in table], "page_id long, url string, html string, type int, payload string, start int")
    got = sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in rows(
        warc.archived(pages, range_bytes=700))), key=str)
    assert got == _want_pages(table)
    assert rows(warc.archived(pages.limit(0))) == []


def test_small_payloads_are_never_revisits_and_payloads_come_back(spark):
    ship(spark)
    pages = spark.createDataFrame([(i, "u", "ab" if i < 3 else "abcdef") for i in range(6)], "page_id long, url string, html string")
    path = checkpoint_dir(spark).rstrip("/") + "/warc/small"
    warc.write_pages(pages, path, least=4, file_bytes=300)
    got = rows(warc.read_records(spark, path))
    assert sorted((r["record_id"], r["type"], bytes(r["payload"]) if r["payload"] is not None else None) for r in got) == [
        *((f"<urn:page:{i}>", "response", b"ab") for i in range(3)), ("<urn:page:3>", "response", b"abcdef"),
        *((f"<urn:page:{i}>", "revisit", None) for i in (4, 5))]
    assert all(r["intact"] for r in got if r["type"] == "response")


def test_an_archive_inside_a_payload_is_not_read(spark):
    """A stored archive in a record that ranges cut: its members look like records to the scan."""
    import pyarrow.fs as pafs
    ship(spark)
    rng = random.Random(3)
    inner = b"".join(warc.member(1000 + i, "in", rng.randbytes(300), None) for i in range(40))
    packer = [warc.member(1, "a", b"x", None), warc.member(2, "b", inner, None, level=0), warc.member(3, "c", b"y", None)]
    files, root = pafs.FileSystem.from_uri(checkpoint_dir(spark) if ":" in checkpoint_dir(spark) else "file://" + checkpoint_dir(spark))
    files.create_dir(f"{root}/nested", recursive=True)
    with files.open_output_stream(f"{root}/nested/a.warc.gz", compression=None) as f:
        f.write(b"".join(packer))
    for step in (500, 5_000, 10**6):
        got = rows(warc.read_records(spark, checkpoint_dir(spark).rstrip("/") + "/nested", step))
        assert sorted(r["record_id"] for r in got) == [f"<urn:page:{i}>" for i in (1, 2, 3)], step


# manifest

def _h(x):
    return hashlib.sha256(x.encode()).hexdigest()


def _levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([_h("".join(out[-1][i:i + 3])) for i in range(0, len(out[-1]), 3)])
    return out


def _sides(levels, i):
    for level in levels[:-1]:
        s = i - i % 3
        yield "".join(level[s:i]), "".join(level[i + 1:s + 3])
        i //= 3


def _manifest(table):
    def digest(r):
        return _h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in r))

    by = {}
    for r in table:
        by.setdefault(r[1], []).append(r)
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for s in sources:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, digest(r)))
    trees = [_levels([digest(r) for r in by[s]]) for s in sources]
    top = _levels([t[-1][0] for t in trees])
    out = []
    for k, s in enumerate(sources):
        for i, r in enumerate(by[s]):
            sides = [*_sides(trees[k], i), *_sides(top, k)]
            text = r[4]
            if text is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0:
                text = text.replace("\n", "")
            f = digest((*r[:4], text))
            for left, right in sides:
                f = _h(left + f + right)
            out.append((r[0], trees[k][0][i], trees[k][-1][0], top[-1][0], "".join(a + b for a, b in sides), f, f == top[-1][0]))
    return sorted(out, key=str)


def _verified(spark, table):
    docs = spark.createDataFrame([(*r, 1, "q") for r in table],
                                 "doc_id long, source string, lang string, n_chars long, text string, hash int, tree string")
    got = rows(manifest.verify(docs, manifest.without_line_ends(docs)))
    return sorted(((r["doc_id"], r["leaf"], r["subroot"], r["root"], r["siblings"], r["folded_root"], r["verified"]) for r in got), key=str)


@pytest.mark.parametrize("sizes", [[1], [3, 1], [244], [1, 2, 4, 9, 28, 243, 730]])
def test_manifest_against_brute_force(spark, sizes):
    table = [(100 * i + 7 * j, f"s{i}é" if i else None, "en", None if j % 5 else j, f"a\nb{j}" if j % 3 else None)
             for i, n in enumerate(sizes) for j in range(n)]
    assert _verified(spark, table) == _manifest(table)


def test_manifest_of_odd_rows(spark):
    """Null ids and columns, repeated rows, ids beyond 2^53, a very long text, an empty table, more sources than a block."""
    table = [(None, None, None, None, None), (None, "", "", 0, ""), (1, "", "x", 1, "t\n"), (1, "", "x", 1, "t\n"), (1, "", "x", 1, "u"),
             (2**60 + 1, "", "x", 1, "v\n"), (2**60, "", "x", 1, "w\n"), (5, "t", "de", 2, "é\n" * 200_000)]
    table += [(i, f"source {i}", "en", 1, "\n") for i in range(300)]
    assert _verified(spark, table) == _manifest(table)
    assert _verified(spark, []) == []


# collocations

def _collocations(table, floor, first, share=80):
    f, n = {}, Counter()
    for lang, text in table:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i:i + k])] = f.get((lang, tuple(w[i:i + k])), 0) + 1
    kept = {x: a for x, a in f.items() if len(x[1]) > 1 and a >= floor}
    around = {}
    for (lang, p), a in kept.items():
        for k in range(2, len(p)):
            for i in range(len(p) - k + 1):
                key = (lang, p[i:i + k])
                around[key] = max(around.get(key, 0), a)
    out = []
    for lang in n:
        scored = []
        for (own, p), a in kept.items():
            if own == lang and not 100 * around.get((lang, p), 0) >= share * a:
                cuts = [(2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k) for k in range(1, len(p))]
                score, k = min(cuts)
                scored.append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(scored)[:first], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


def _mined(spark, table, **how):
    docs = spark.createDataFrame([(*r, 1, 2, 3, 4) for r in table], "lang string, text string, doc_id long, n long, id long, bucket int")
    got = rows(collocations.mine(docs, **how))
    return sorted((r["lang"], r["rank"], r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in got)


def _prose(seed):
    rng = random.Random(seed)
    vocabulary = ["The", "of", "a", "é", "xx", "Ünder", "new", "york", "city", "hall", "\x00", "it's", " b"]
    table = []
    for i in range(120):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(60))]
        text = "".join(w + rng.choice([" ", "  ", "\t", " ", " ", ", ", ".", "\n", "\r", "\x0b", " "]) for w in words)
        table.append((rng.choice(["en", "de", None, "und", ""]), text + " new york city hall" * rng.randrange(4)))
    return [*table, ("en", None), ("fr", ""), ("en", "...  \t"), (None, "same " * 5000), ("en", table[3][1]), ("en", table[3][1])]


@pytest.mark.parametrize("bits", [64, 3])
def test_collocations_against_brute_force(spark, bits):
    """With three bits of the first hash nearly all words clash, and their second hash tells them apart."""
    ship(spark)
    table = _prose(4)
    assert _mined(spark, table, floor=6, first=25, bits=bits) == _collocations(table, 6, 25)


def test_collocations_pointers_in_many_parts(spark, monkeypatch):
    ship(spark)
    table = _prose(5)
    monkeypatch.setattr(collocations, "POINTERS", 300)
    assert _mined(spark, table, floor=4, first=2000) == _collocations(table, 4, 2000)
    assert _mined(spark, table[:0]) == [] and _mined(spark, [(None, None)]) == []


def test_quicksort_counts_prefixes():
    rng = random.Random(6)
    for _ in range(100):
        n = rng.randrange(0, 300)
        columns = np.array([[rng.randrange(1, 4 + 3 * d) for _ in range(n)] for d in range(4)], np.uint64).reshape(4, n)
        for j in range(n):
            columns[rng.choice([2, 3, 4, 4]):, j] = 0
        weight = np.array([rng.randrange(1, 5) for _ in range(n)], np.int64)
        want = Counter()
        for j in range(n):
            for d in range(1, 5):
                if columns[d - 1, j]:
                    want[tuple(columns[:d, j])] += weight[j]
        at, deep, a = collocations.quicksort(columns, weight, 10)
        assert {tuple(columns[:d, i]): c for i, d, c in zip(at, deep, a, strict=True)} == {k: v for k, v in want.items() if v >= 10}
        assert len(at) == len({tuple(columns[:d, i]) for i, d in zip(at, deep, strict=True)})


def test_crc_of_the_tampering(spark):
    docs = spark.createDataFrame([(i, "a\nb") for i in (0, 7, -3, 2**62)], "doc_id long, text string")
    got = rows(docs.select("doc_id", manifest.without_line_ends(docs).alias("t")))
    assert [r["t"] for r in got] == ["ab" if zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0 else "a\nb" for r in got]
    assert docs.where(F.lit(False)).count() == 0
