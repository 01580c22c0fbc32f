"""The training-data operators on a small table of odd rows, against brute force."""

import hashlib
import itertools
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import bpe, chat, hnsw, merkle, neardup, packing, pii, quality, substring, toxicity
from tessera.llm.text import ship

BASE = " ".join(f"word{i % 61}x{i}" for i in range(120))
NEAR = BASE.replace("word5x5 ", "other ")
TEXTS = [
    (1, BASE), (2, NEAR), (3, BASE), (4, None), (5, ""), (6, "one two"), (7, "One TWO"), (8, " \n\t "),
    (9, "lead " + BASE + " tail"), (10, "é😀 mail a.b@c.de 10.0.0.1, 4111 1111 1111 1111 +1 (988) 555-2485 \n x"),
    (11, "z" * 5000), (12, "same " * 400), (12, "same " * 400), (None, "no id"), (13, "<|endoftext|> [INST] \\ </s>"),
    (14, "para one here\npara two here\n\nsection three and more words in it")]
SCHEMA = "doc_id long, text string, key long, n int, score double, spans string"


@pytest.fixture(scope="module")
def docs(spark):
    ship(spark)
    return spark.createDataFrame([(d, t, 1, 2, 0.5, "x") for d, t in TEXTS], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    ship(spark)
    return spark.createDataFrame([], SCHEMA)


def rows(df):
    return [r.asDict() for r in df.collect()]


def words(text, lower=False):
    text = text or ""
    if lower:
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    return re.findall(r"[^\x20\x09-\x0D]+", text)


def test_bpe_equals_the_library(docs, empty):
    path = P.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    got = rows(bpe.encode(docs, path))
    assert len(got) == len(TEXTS)
    by = {(r["doc_id"]): r for r in got}
    for d, t in TEXTS:
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert by[d]["ids"] == ids and by[d]["n_tokens"] == len(ids)
        assert by[d]["decoded"] == library.decode(ids, skip_special_tokens=False)
        assert by[d]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    assert rows(bpe.encode(empty, path)) == []


def test_bpe_long_words_and_rows_agree():
    coder = bpe.Bpe(P.path("word_bpe_49k.json"))
    for word in (b"internationalization", b"aaaaaaaaaaaaaaa", b"x"):
        assert coder._merge_rows([word], 32) == [coder._merge_long(word)]


def test_packing_is_whole_and_tight(docs, empty):
    args = (P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    library = Tokenizer.from_file(args[0])
    got = rows(packing.pack_documents(docs, *args, capacity=64))
    want = sorted(zlib.crc32(np.array(library.encode(t or "", add_special_tokens=False).ids + [0], "<u4").tobytes())
                  for d, t in TEXTS if len(library.encode(t or "", add_special_tokens=False).ids) < 64)
    whole = sorted(r["ids_crc32"] for r in got if r["piece"] == 0 and r["length"] < 64 and
                   not any(o["doc_id"] == r["doc_id"] and o["piece"] for o in got))
    assert whole == want
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert len(bins) <= 1.1 * sum(r["length"] for r in got) / 64 + 2
    assert rows(packing.pack_documents(empty, *args)) == []


def test_packing_plan_matches_best_fit_size():
    rules, opened = packing.plan({700: 3, 1400: 2, 600: 5, 100: 20, 2048: 1})
    placed = sum(b - a for _, a, b, *_ in rules)
    assert placed == 31 and opened == -(-(3 * 700 + 2 * 1400 + 5 * 600 + 20 * 100 + 2048) // 2048)


def test_near_duplicates_against_brute_force(docs, empty):
    got = rows(neardup.near_duplicates(docs))
    sets = {}
    for d, t in TEXTS:
        w = words(t, True)
        sets[d] = {tuple(w[i:i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())
    comp = {d: d for d in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if a is not None and b is not None and sets[a] and sets[b] and (
                        100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])):
                    comp[a] = comp[b] = min(comp[a], comp[b])
    assert len(got) == len(TEXTS)
    for r in got:
        assert r["n_shingles"] == len(sets[r["doc_id"]]) and r["component_id"] == comp[r["doc_id"]]
        assert r["kept"] == (r["doc_id"] == r["component_id"])
    assert {r["component_id"] for r in got if r["doc_id"] in (1, 2, 3, 9)} == {1}
    assert rows(neardup.near_duplicates(empty)) == []


def test_near_duplicates_of_one_large_group(spark):
    """Copies with one to many edits of one text: stars, then whole sets, give the brute-force classes."""
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(150)]
    texts = []
    for i in range(60):
        w = list(base)
        for at in rng.integers(0, 150, rng.integers(0, 9)):
            w[at] = f"e{rng.integers(0, 40)}"
        texts.append((i, " ".join(w)))
    sets = [{tuple(t.split()[i:i + 5]) for i in range(146)} for _, t in texts]
    comp = list(range(60))
    for _ in range(60):
        for a in range(60):
            for b in range(60):
                if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    comp[a] = comp[b] = min(comp[a], comp[b])
    ship(spark)
    got = {r["doc_id"]: r["component_id"] for r in rows(neardup.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string")))}
    assert got == dict(enumerate(comp))


def test_near_duplicates_across_the_sketch_size(spark):
    """Pairs at the limit, one set held whole by its sketch and the other not, whose other values are the rarest."""
    texts, sizes = [], [(118, 150), (118, 157), (122, 162), (126, 168), (128, 170)]
    for i in range(40):
        for j, (n, m) in enumerate(sizes):
            w = [f"p{i}x{j}x{at}" for at in range(m + 4)]
            pair = 2 * (i * len(sizes) + j)
            texts += [(pair, " ".join(w[:n + 4])), (pair + 1, " ".join(w))]
    ship(spark)
    got = {r["doc_id"]: r["component_id"] for r in rows(neardup.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string")))}
    assert got == {d: d - d % 2 for d, _ in texts}


def test_substring_against_brute_force(docs, empty):
    got = rows(substring.deduplicate(docs))
    seen = {}
    for _, t in TEXTS:
        w = words(t)
        for i in range(len(w) - 34):
            seen[tuple(w[i:i + 35])] = seen.get(tuple(w[i:i + 35]), 0) + 1
    want = []
    for d, t in TEXTS:
        w = words(t)
        gone = set()
        for i in range(len(w) - 34):
            if seen[tuple(w[i:i + 35])] > 1:
                gone.update(range(i, i + 35))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        want.append((str(d), len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got) == sorted(want)
    assert rows(substring.deduplicate(empty)) == []


def removed_words(texts, window=35):
    """(n_words, n_removed, kept_sha256) of each text, by comparing all windows."""
    seen = {}
    for t in texts:
        w = words(t)
        for i in range(len(w) - window + 1):
            seen[tuple(w[i:i + window])] = seen.get(tuple(w[i:i + window]), 0) + 1
    out = []
    for t in texts:
        w = words(t)
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i:i + window])] > 1:
                gone.update(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [10, 100_000])
def test_substring_passages_forks_and_hot_owners(spark, monkeypatch, hot):
    monkeypatch.setattr(substring, "HOT", hot)
    rng = np.random.default_rng(3)
    plain = lambda n: " ".join(map(str, rng.integers(0, 10**9, n)))
    shared, fork, phrase = plain(200), plain(90), plain(8)
    texts = [f"{plain(30)} {shared} {plain(rng.integers(1, 50))}" for _ in range(60)]
    texts += [f"{fork} {plain(40)}" for _ in range(6)] + [" ".join(fork.split()[i:i + 60]) for i in range(0, 30, 7)]
    texts += [f"{plain(28)} {phrase} {plain(28)}" for _ in range(80)] + [plain(300), "a b " * 60, shared, shared, None, ""]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring.deduplicate(table).collect()}
    assert got == dict(enumerate(removed_words(texts)))


def test_lines_written_many_times_are_one_row(spark):
    """A document's rows do not grow with the times that it repeats a line, and what is removed stays the same."""
    rng = np.random.default_rng(6)
    plain = lambda n: " ".join(map(str, rng.integers(0, 10**9, n)))
    texts = [f"{plain(40)} {'Is onhe. ' * m}{plain(tail)}" for m, tail in [(300, 0), (280, 30), (41, 0), (18, 50), (17, 40), (1, 60)] * 3]
    texts += ["x " * m for m in (34, 35, 36, 37, 200)] + ["Is onhe. " * 17 + "Is", "onhe. Is " * 60, f"{plain(9)} " * 30 + plain(50)]
    line = plain(33)
    texts += [f"{line} " * 9 + plain(45), plain(45) + f" {line}" * 2, line, "", None]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    every = substring.paths(table.select(F.col("doc_id").alias("key"), "text")).collect()
    assert not [r for r in every if r["path"] in (r["prv"], r["nxt"])]
    assert max(Counter((r["key"], r["path"]) for r in every if r["key"] < 18).values()) == 1
    for one, each in itertools.groupby(sorted(every, key=lambda r: (r["key"], r["a"])), key=lambda r: r["key"]):
        each = list(each)
        assert each[0]["a"] == 0 and each[-1]["last"] == len(words(texts[one])) - 35
        assert all(r["last"] - r["a"] + 1 >= r["n"] >= 1 and (r["n"] > 1 or r["last"] == r["b"]) for r in each)
        assert all(s["a"] == r["last"] + 1 for r, s in itertools.pairwise(each))
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring.deduplicate(table).collect()}
    assert got == dict(enumerate(removed_words(texts)))


def test_passages_compact_to_one_row(spark):
    rng = np.random.default_rng(4)
    plain = lambda n: " ".join(map(str, rng.integers(0, 10**9, n)))
    shared = plain(500)
    table = spark.createDataFrame([(i, f"{plain(40)} {shared} {plain(40)}") for i in range(20)], "key long, text string")
    every = substring.paths(table)
    distinct = every.groupBy("owner", "path").agg(
        F.count("*").alias("times"), F.min(F.struct("key", "a", "b")).alias("at"), F.min("prv").alias("least_prv"),
        F.max("prv").alias("most_prv"), F.min("nxt").alias("least_nxt"), F.max("nxt").alias("most_nxt")).where("times > 1")
    found = {(r["path"], r["times"], r["size"]) for r in substring.unitigs(distinct).collect()}
    places = {}
    for r in every.collect():
        places.setdefault(r["path"], []).append(r)
    places = {p: rs for p, rs in places.items() if len(rs) > 1}
    after = {}
    for p, rs in places.items():
        before = {r["prv"] for r in rs}
        if len(before) == 1 and all(r["nxt"] == p for r in places.get(min(before), [])) and min(before) in places:
            after[min(before)] = p
    want = set()
    for p in places.keys() - set(after.values()):
        end, size = p, 34
        while True:
            size += places[end][0]["b"] - places[end][0]["a"] + 1
            if end not in after:
                break
            end = after[end]
        want.add((p, len(places[p]), size))
    assert found == want and len(places) > 20
    # edges of the passage end where other words own a window, by chance alike in some documents; its inside is one run
    assert sum(times == 20 for _, times, _ in found) == 1


def test_pii_base_spans_and_discovery(spark, docs, empty):
    got = {r["doc_id"]: r for r in rows(pii.find(docs).select("doc_id", pii.span_string("base").alias("b")))}
    text = dict((d, t) for d, t in TEXTS)[10]
    want = []
    for kind, pattern in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
                          ("card", r"4111 1111 1111 1111"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        want += [f"{kind}:{m.start()}:{m.end()}" for m in re.finditer(pattern, text)]
    assert got[10]["b"] == ",".join(want) and got[4]["b"] == "" and got[None]["b"] == ""
    known = [(i, f"Please call me at +1 (988) 555-{1000 + i} today") for i in range(30)]
    more = spark.createDataFrame(known + [(99, "call me at 988-555-2001, thanks")], "doc_id long, text string")
    found = {r["doc_id"]: r["s"] for r in rows(pii.find(more).select("doc_id", pii.span_string("spans").alias("s")))}
    assert found[99] == "phone:11:23"
    masked = {r["doc_id"]: r["text"] for r in rows(pii.mask(more))}
    assert masked[99] == "call me at [PHONE], thanks" and masked[0] == "Please call me at [PHONE] today"
    assert rows(pii.find(empty)) == [] and rows(pii.mask(empty)) == []


def test_pii_discovers_runs_addresses_and_words_after_numbers(spark):
    ship(spark)
    names = [a + b for a in ("ann", "bob", "cy", "dee", "eve", "flo") for b in ("ko", "li", "mo")]
    cards = []
    for i in range(400):
        digits = f"41111111111{i:04d}"
        odd = sum(sum(divmod(2 * int(c), 10)) if j % 2 == 0 else int(c) for j, c in enumerate(digits))
        cards.append(digits + str(-odd % 10))
    known = [(i, f"please call me at +1 (988) 555-{1000 + i} today") for i in range(20)]
    known += [(100 + i, "my card is " + " ".join(cards[i][j:j + 4] for j in range(0, 16, 4)) + " ok") for i in range(20)]
    known += [(200 + i, f"kindly write to {n}@example.org now") for i, n in enumerate(names)]
    known += [(300 + i, f"reach line no. 1: +1 988 555 {1000 + i} today") for i in range(20)]
    new = {900: ("call me at (988) 555-2001 soon", "(988) 555-2001", "phone"), 901: ("my card is 4111 1111 1111 1112 ok", "4111 1111 1111 1112", "card"),
           902: ("write to zoe(at)example.org now", "zoe(at)example.org", "email"), 903: ("write to zoe at example dot org now", "zoe at example dot org", "email"),
           904: ("see line no. 1: 988-555-2001, now", "988-555-2001", "phone"), 905: ("write to nobody at home", None, None)}
    table = spark.createDataFrame(known + [(d, t) for d, (t, _, _) in new.items()], "doc_id long, text string")
    got = {r["doc_id"]: r["s"] for r in rows(pii.find(table).select("doc_id", pii.span_string("spans").alias("s")))}
    for d, (text, part, kind) in new.items():
        assert got[d] == (f"{kind}:{text.index(part)}:{text.index(part) + len(part)}" if part else ""), (d, got[d])


def test_fingerprints(docs, empty):
    got = rows(merkle.fingerprints(docs))
    order = sorted(((d, t or "") for d, t in TEXTS if d is not None))
    want = []
    for i, (d, t) in enumerate(order):
        q = len(t) // 4
        edited = t[:len(t) - q] + order[(i + 1) % len(order)][1][:q]
        want.append((d, len(t), hashlib.sha256(edited.encode()).hexdigest(), edited == t))
    assert sorted((r["doc_id"], r["n_chars"], r["edited_sha256"], r["fingerprint"] == r["edited_fingerprint"])
                  for r in got if r["doc_id"] is not None) == sorted(want)
    prints = {}
    for r in got:
        prints.setdefault(r["fingerprint"], set()).add(r["doc_id"])
    assert {1, 3} in prints.values() and {4, 5} in prints.values() and len(got) == len(TEXTS)
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    assert rows(merkle.fingerprints(empty)) == []


@pytest.mark.parametrize("kind", ["far", "random", "dense"])
def test_fingerprints_of_ids_beyond_doubles(spark, kind):
    """The next document is found by integers, in many slices, whatever the ids."""
    ship(spark)
    rng = np.random.default_rng(9)
    ids = {"far": [2**60 + 1000 * i for i in range(80)], "random": rng.integers(-2**63, 2**63 - 1, 80).tolist(),
           "dense": [2**62 + i for i in range(80)]}[kind]
    table = [(d, f"text {i} " * int(rng.integers(1, 30))) for i, d in enumerate(ids)]
    got = rows(merkle.with_next(spark.createDataFrame(table, "doc_id long, text string").repartition(5), slice_rows=4))
    order = sorted(table)
    assert sorted((r["doc_id"], r["text"], r["next_text"]) for r in got) == [
        (d, t, order[(i + 1) % len(order)][1]) for i, (d, t) in enumerate(order)]


def test_slices_by_integers(spark):
    starts = [-5, 0, 7, 8, 2**60, 2**60 + 1, 2**63 - 2]
    values = [*starts, -9, 6, 9, 2**60 + 2, 2**63 - 1]
    got = {r["v"]: r["s"] for r in rows(spark.createDataFrame([(v,) for v in values], "v long").select(
        "v", merkle.slice_of(F.col("v"), starts).alias("s")))}
    assert got == {v: max([i for i, s in enumerate(starts) if s <= v], default=0) for v in values}


def test_likeness_and_located_edits(spark):
    """Likeness is the share of common leaves; an edit is located in its section and paragraph."""
    ship(spark)
    words = [[f"w{i}x{j}" for j in range(12)] for i in range(20)]
    a = "\n".join(" ".join(p) for p in words)
    words[11][5] = "changed"
    b = "\n".join(" ".join(p) for p in words)
    made = spark.createDataFrame([(a, b), (a, a), ("", ""), (a, ""), ("x y", "z")], "a string, b string").select(
        "*", merkle.leaves(F.col("a")).alias("x"), merkle.leaves(F.col("b")).alias("y"))
    got = rows(made.select(merkle.likeness(F.col("x"), F.col("y")).alias("l"),
                           merkle.first_difference(merkle.paragraphs(F.col("x")), merkle.paragraphs(F.col("y"))).alias("p"),
                           merkle.first_difference(merkle.sections(merkle.paragraphs(F.col("x"))), merkle.sections(merkle.paragraphs(F.col("y")))).alias("s")))
    assert [(round(r["l"], 9), r["p"], r["s"]) for r in got] == [(round(59 / 61, 9), 11, 1), (1, None, None), (1, None, None), (0, 0, 0), (0, 0, 0)]


@pytest.mark.parametrize("module,label", [(quality, "quality"), (toxicity, "toxic")])
def test_classifiers(spark, docs, empty, module, label):
    rng = np.random.default_rng(2)
    vocabulary = [f"w{i}" for i in range(300)]
    texts, marks = [], []
    for i in range(240):
        w = list(rng.choice(vocabulary, 40))
        bad = i % 4 == 0
        if bad and module is quality:
            w = [x.upper() + "!!" for x in w]
        if bad and module is toxicity:
            for at in rng.integers(0, 40, 3):
                w[at] = str(rng.choice(["grubnak", "zolfrit"]))
        texts.append((i, " ".join(w)))
        marks.append((i, int(not bad) if module is quality else int(bad)))
    table = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame(marks, f"doc_id long, {label} int")
    model = module.fit(table, labels, label, F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) != 2)
    got = {r["doc_id"]: r["predicted"] for r in rows(module.score(table, model, 0.5))}
    assert np.mean([got[d] == y for d, y in marks]) > 0.97
    odd = rows(module.score(docs, model, 0.5))
    assert len(odd) == len(TEXTS) and all(0 <= r["score"] <= 1 for r in odd)
    assert rows(module.score(empty, model, 0.5)) == []
    none = module.fit(table, labels.limit(0), label, F.lit(True))
    assert all(0 <= r["score"] <= 1 for r in rows(module.score(docs, none, 0.5)))


def test_chat_layouts_and_round_trip(spark):
    ship(spark)
    odd = spark.createDataFrame([(1, 0, "user", "a <b> [c] \\ <|end|>", 5), (1, 1, "assistant", None, 5), (1, 1, "assistant", "x\\<", 5),
                                 (None, 0, None, "y", 5)], "conv_id long, turn long, role string, text string, formatted int")
    made = chat.format_turns(chat.canonical_turns(odd)).collect()
    for r in made:
        assert chat.parse(r["formatted"]) == [(r["role"], r["text"])]
        assert "<b" not in r["formatted"] and "[c" not in r["formatted"]
    got = {r["conv_id"]: r for r in rows(chat.read_back(chat.format_turns(chat.canonical_turns(odd))))}
    assert got[1]["n_turns"] == 3 and got[1]["loss_sha256"] == hashlib.sha256(b"x\\<").hexdigest()
    records = ['{"id":1,"prompt":"p","response":"r"}', '{"instruction":"i","input":"k","output":"o"}',
               '{"conversations":[{"from":"human","value":"h"},{"from":"gpt","value":"g"}]}', "[]", None, "{", '{"what":1}']
    table = spark.createDataFrame(list(enumerate(records)), "i long, j string")
    turns = [(r["conv_id"], r["role"], r["text"], r["layout_known"]) for r in rows(chat.canonical_records(table, "i", "j"))]
    assert turns == [(0, "user", "p", True), (0, "assistant", "r", True), (1, "user", "i\nk", True), (1, "assistant", "o", True),
                     (2, "user", "h", True), (2, "assistant", "g", True), *((n, None, None, False) for n in (3, 4, 5, 6))]
    with pytest.raises(ValueError):
        chat.canonical_turns(table)
    assert rows(chat.read_back(chat.format_turns(chat.canonical_turns(odd.limit(0))))) == []


def test_neighbours_against_brute_force(spark):
    ship(spark)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 8))
    x[40:60] = x[3]
    table = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    table += [(400, None), (420, [0.0] * 8), (440, [float("nan")] + [1.0] * 7), (None, [1.0] * 8), (460, [1.0, None] + [1.0] * 6), (0, table[0][1])]
    got = rows(hnsw.nearest(spark.createDataFrame(table, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0))
    hits = 0
    for q in range(0, 300, 20):
        score = x @ x[q]
        want = [i for i in np.lexsort((np.arange(300), -score)) if i != q][:20]
        mine = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, 21))
        assert all(abs(r["score"] - score[r["vec_id"]]) < 1e-9 for r in mine)
        hits += len(set(want) & {r["vec_id"] for r in mine})
    assert hits >= 0.95 * 20 * 15 and {r["query_id"] for r in got} == set(range(0, 300, 20))
    none = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert rows(hnsw.nearest(none, F.col("vec_id") % 20 == 0)) == []


def test_neighbours_with_the_default_beam():
    """Vectors without clusters: a beam of 64 finds 0.955 of the true neighbours."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(2000, 32))
    found = hnsw.search_graph(x, hnsw.build_graph(x, rng.permutation(2000)), x[:200])
    hits = 0
    for own, near in zip(x[:200], found, strict=True):
        near = near[near >= 0]
        hits += len(set(np.argsort(-(x @ own))[:20]) & set(near[np.argsort(-(x[near] @ own))[:20]]))
    assert hits >= 0.97 * 20 * 200
