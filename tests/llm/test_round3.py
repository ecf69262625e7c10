"""Tests of SimHash, conversation repair and the Merkle manifest."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from gristmill.llm import merkle, queries, repair, simhash

SF = "/root/testdata/sf0.001"
LONG = "word thing " * 30_000
EDGES = [(1, None), (2, ""), (3, " \n\t "), (4, LONG), (5, "one two"), (6, "One  TWO"), (7, "é\x00ñ 漢字 x"), (8, "a b c d e f g"), (8, "a b c d e f g"), (8, "other text of one id"), (10, "other text of one id"), (None, "a b c d e f g"), (9, "x" * 70000)]


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


# --- SimHash ---------------------------------------------------------------------------


def simhash_of(text):
    import xxhash

    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text or ""))
    shingles = ([" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]) if w else []
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(pairs, ids):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {i: find(i) for i in ids}


def test_simhash_like_brute_force(spark):
    texts = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows = texts + [(100_000 + i if i is not None else None, t) for i, t in EDGES]
    docs = spark.createDataFrame([(i, t, "c", 1) for i, t in rows], "doc_id long, text string, component_id string, fingerprint int").repartition(3)
    prints = [(i, simhash_of(t)) for i, t in rows]
    named = [(i, p) for i, p in prints if i is not None]
    want = groups([(a, b) for (a, p), (b, q) in itertools.combinations(named, 2) if (p ^ q).bit_count() <= 2], {i for i, _ in named})
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["fingerprint"] & (2**64 - 1), r["component_id"]) for r in simhash.near_duplicates(docs).collect())
    assert got == sorted((-1 if i is None else i, p, want.get(i)) for i, p in prints)
    assert sum(want[i] != i for i in want) > 10
    assert simhash.near_duplicates(docs.limit(0)).collect() == []


def test_query_of_simhash(spark):
    got = {r["doc_id"]: r["fingerprint"] for r in queries.QUERIES["op11_simhash"](spark, SF).collect()}
    assert got == {r["doc_id"]: f"{simhash_of(r['text']):016x}" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def test_ball_hashing_connects_all_within_the_radius(spark):
    rnd = random.Random(3)
    prints = {0, 2**64 - 1, 1 << 63}
    for _ in range(12):
        now = rnd.getrandbits(64)
        for _ in range(25):  # chains and stars of one to three flips
            prints.add(now)
            now ^= sum(1 << b for b in rnd.sample([*range(6), 62, 63], rnd.randint(1, 3)))
    prints = sorted(p - (1 << 64) if p >> 63 else p for p in prints)
    near = [(a, b) for a, b in itertools.combinations(prints, 2) if ((a ^ b) & (2**64 - 1)).bit_count() <= 2]
    pairs = [(r["x"], r["y"]) for r in simhash.colliding_pairs(spark.createDataFrame([(p,) for p in prints], "fingerprint long")).collect()]
    assert set(pairs) <= set(near) and len(set(pairs)) == len(pairs)
    assert groups(pairs, prints) == groups(near, prints)


def test_majority_over_blocks(monkeypatch):
    import numpy as np

    rnd = np.random.default_rng(1)
    counts = np.array([0, 5, 1, 40, 0, 7, 2])
    hashes = rnd.integers(0, 2**63, int(counts.sum()), dtype=np.uint64)
    whole = simhash.majority(hashes, counts)
    monkeypatch.setattr(simhash, "_BLOCK", 6)
    assert (simhash.majority(hashes, counts) == whole).all() and whole[0] == whole[4] == 0
    assert whole[2] == hashes[5]


# --- Merkle manifest -------------------------------------------------------------------


def leaf_of(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree_of(leaves):
    """The root, and the siblings of each leaf as lists of (before, after)."""
    level, at, paths = list(leaves), list(range(len(leaves))), [[] for _ in leaves]
    while len(level) > 1:
        for path, p in zip(paths, at, strict=True):
            run = level[p // 8 * 8 : p // 8 * 8 + 8]
            path.append((run[: p % 8], run[p % 8 + 1 :]))
        level, at = [sha("".join(level[i : i + 8])) for i in range(0, len(level), 8)], [p // 8 for p in at]
    return level[0], paths


@pytest.mark.parametrize("sizes", [(1,), (1, 1), (8, 9, 1), (65, 3, 0, 513), tuple([1] * 20)])
def test_manifest_like_brute_force(spark, sizes):
    rows = []
    for g, n in enumerate(sizes):
        lang = None if g == 0 else "é" if g == 1 else f"L{g:02d}"
        rows += [(i if i % 11 else None, [None, "", f"Text {i} É", LONG[: 100 * i]][i % 4], lang, [None, "s", f"S{i}"][i % 3], None if i % 5 == 0 else i, "x") for i in range(n)]
    rows += rows[:2]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, tree string").repartition(3).withColumn("place", F.lit("p")).withColumn("leaf", F.lit(1))
    by = {}
    for i, text, lang, source, n, _ in rows:
        low = None if text is None else lower(text)
        changed = i is not None and zlib.crc32(str(i).encode()) % 3 == 0
        by.setdefault(lang, []).append((i, leaf_of((i, source, lang, n, text)), leaf_of((i, source, lang, n, low)) if changed else None))
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        by[lang].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        trees[lang] = tree_of([r[1] for r in by[lang]])
    root, tops = tree_of([trees[x][0] for x in langs])
    want = []
    for lang, top in zip(langs, tops, strict=True):
        for (i, leaf, other), path in zip(by[lang], trees[lang][1], strict=True):
            now = other or leaf
            for before, after in path + top:
                now = sha("".join([*before, now, *after]))
            want.append((i, leaf, trees[lang][0], root, sha("".join(x for pair in path + top for side in pair for x in side)), now, now == root))
    docs.createOrReplaceTempView("docs_to_sign")
    tampered = merkle.row_hash([F.col(c) for c in ("doc_id", "source", "lang", "n_chars")] + [F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")])
    done = merkle.manifest(docs, also={"tampered": F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, tampered)})
    steps = F.col("steps")
    folded = merkle.fold(F.coalesce("tampered", "leaf"), steps)
    got = done.select("doc_id", "leaf", "subroot", "root", F.sha2(merkle.siblings(steps), 256), folded, folded == F.col("root")).collect()
    order = lambda r: (r[0] is not None, r[0] or 0, *r[1:])
    assert sorted(map(tuple, got), key=order) == sorted(want, key=order)
    assert {lang for lang in langs} == {r["lang"] for r in done.select("lang").distinct().collect()}


def test_manifest_of_nothing_and_places_by_a_join(spark, monkeypatch):
    empty = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    assert merkle.manifest(empty).collect() == []
    monkeypatch.setattr(merkle, "BROADCAST_RANGES", 0)
    rows = spark.createDataFrame([("a" if i % 3 else "b", i * 7 % 101) for i in range(101)], "g string, v long").repartition(5)
    got = {g: [r["v"] for r in sorted(merkle.places(rows, "g", ["v"]).where(F.col("g") == g).collect(), key=lambda r: r["place"])] for g in "ab"}
    assert all(v == sorted(v) for v in got.values()) and len(got["a"]) + len(got["b"]) == 101


# --- conversation repair ---------------------------------------------------------------


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def repaired(rows, delete=2, insert=5):
    """(cost, audit, lines) by trying each edit at each place, kept for each state."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), hashlib.sha256(r[3].encode()).digest()))
    seen, faults = set(), []
    for _, _, role, text in rows:
        last = re.findall(r"[^\x20\x09-\x0D]", text)[-1:]
        faults.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[0] not in ".!?" else None)
        seen.add((role, text))
    after = {"": "su", "s": "u", "u": "a", "a": "u"}
    table = {"": (0, "", ())}  # state: cost, audit, lines

    def inserted(table):
        table = dict(table)
        for _ in range(3):
            for state, (cost, audit, lines) in list(table.items()):
                for to in after[state]:
                    if to != "s":
                        new = (cost + insert, audit + "I", (*lines, f"{repair.NAMES[to]}:"))
                        table[to] = min(table.get(to, new), new)
        return table

    for (_, _, role, text), fault in zip(rows, faults, strict=True):
        new = {}
        for state, (cost, audit, lines) in inserted(table).items():
            options = [(state, (cost + delete, audit + "D", lines))]
            if fault not in ("blank", "duplicate"):
                extra = 5 * (fault == "truncated")
                for to in after[state]:
                    if role[:1] == to:
                        options.append((to, (cost + extra, audit + "K", (*lines, f"{role}:{text}"))))
                    if to != "s":
                        options.append((to, (cost + extra + 1, audit + "R", (*lines, f"{repair.NAMES[to]}:{text}"))))
            for to, option in options:
                new[to] = min(new.get(to, option), option)
        table = new
    cost, audit, lines = min(v for k, v in inserted(table).items() if k in ("", "a"))
    turns = [r[1] for r in rows if r[1] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    return gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha("\n".join(lines))


def conversations(n, seed, long=12):
    rnd = random.Random(seed)
    rows = []
    for conv in [*range(n), None]:
        texts = [f"Say {conv} {k}." for k in range(6)] + ["no end", "", " \t\n", None, "漢字?", "same."]
        for t in range(rnd.randint(1, long)):
            rows.append((conv, rnd.choice([t, t, t, t + 1, None]), rnd.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "u2"]), rnd.choice(texts)))
    return rows + rows[:5]


def report(spark, rows):
    df = spark.createDataFrame([(*r, 0, "x") for r in rows], "conv_id long, turn long, role string, text string, kind int, digest string").repartition(5)
    return {r["conv_id"]: tuple(r)[1:] for r in repair.repair_report(repair.damage(df), df).collect()}


def test_repair_like_all_edits(spark):
    rows = conversations(150, 4) + [(9001, t, "user" if t % 2 else "assistant", LONG + str(t)) for t in range(5)]
    now = damaged(rows)
    want = {conv: repaired([r for r in now if r[0] == conv]) for conv in {r[0] for r in rows}}
    got = report(spark, rows)
    assert got == want
    assert {c for v in got.values() for c in v[6]} >= set("DKR") and any(not [r for r in now if r[0] == c] for c in want)


@pytest.mark.parametrize("delete,insert", [(2, 5), (7, 2), (3, 3), (1, 1)])
def test_gaps_of_chained_runs(monkeypatch, delete, insert):
    """Runs that know what follows them find together what one run finds, and what trying all edits finds, at other costs too."""
    monkeypatch.setattr(repair, "DELETE", delete)
    monkeypatch.setattr(repair, "INSERT", insert)
    end = tuple(insert * n for n in (0, 2, 1, 0))
    rnd = random.Random(delete)
    letters_seen = set()
    for _ in range(400):
        rows = [(1, t, rnd.choice(["user", "assistant", "system", "", "user"]), rnd.choice([f"{t}.", f"{t}", "same.", ""])) for t in range(rnd.randint(1, 11))]
        seen, turns = set(), []
        for _, _, role, text in rows:
            turns.append((role[:1], not text or (role, text) in seen, text[-1:] != "."))
            seen.add((role, text))
        cuts = sorted(rnd.sample(range(len(turns) + 1), rnd.randint(1, 2)))
        parts = [turns[a:b] for a, b in zip([0, *cuts], [*cuts, len(turns)], strict=True) if b > a]
        never = 1 << 60
        ends = [{"part": i, "conv_id": 1, "costs": [min(x, never) for goal in "-sua" for x in repair.Gaps(p, [0 if s == goal else never for s in "-sua"]).costs(0)]} for i, p in enumerate(parts)]
        monkeypatch.setattr(repair, "END", end)
        after = repair._after({1: ends})
        audit, state = "", "-"
        for i, part in enumerate(parts):
            letters = ["D"] * len(part)
            for j, own, state in repair.Gaps(part, after[i, 1]).walk(state):
                letters[j] = own
            audit += "".join(letters)
        audit += "I" * {"-": 0, "s": 2, "u": 1, "a": 0}[state]
        want = repaired(rows, delete, insert)
        assert (repair.Gaps(parts[0], after[0, 1]).costs(0)[0], audit) == want[5:7]
        letters_seen |= set(audit)
    assert letters_seen >= (set("DIKR") if delete > insert else set("DKR"))


def test_one_conversation_in_many_ranges(spark):
    """Ranges that share a conversation give what one range gives."""
    rnd = random.Random(8)
    rows = [(5, t if rnd.random() > 0.02 else None, rnd.choice(["user", "assistant", "user", "assistant", "system", "tool"]), rnd.choice([f"Line {t}.", f"Line {t}", "Same.", ""])) for t in range(900)] + conversations(4, 6)
    now = damaged(rows)
    want = {conv: repaired([r for r in now if r[0] == conv]) for conv in {r[0] for r in rows}}
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "40")
        assert report(spark, rows) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_repaired_turns_are_those_of_the_report(spark):
    rows = conversations(30, 2)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    turns = repair.repair_turns(repair.damage(df), df).collect()
    said = {}
    for r in sorted(turns, key=lambda r: r["nth"]):
        said.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
    got = report(spark, rows)
    assert all(sha("\n".join(said.get(c, []))) == v[-1] for c, v in got.items())
    for lines in said.values():
        assert re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in lines))
    assert report(spark, []) == {} and repair.repair_turns(repair.damage(df.limit(0))).collect() == []
