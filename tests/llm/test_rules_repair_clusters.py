"""Operators 11 to 13 against brute force, and what they make of odd tables."""

import collections
import hashlib
import heapq
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from mailsieve.llm import centroids, conversation_repair as repair, quality_rules as rules
from mailsieve.llm.common import table

CLASHES = "id row key words lines votes kind fault copy model point near second seq matrix own said c r cluster".split()


def clashing(df):
    return df.select("*", *(F.lit(f"own {c}").alias(c) for c in CLASHES))


# 11 quality rules

PROSE = "The old house stood on a hill. Nobody had lived there for years, and the garden was wild. One day a family came."
TEXTS = [
    None, "", " \n\t\n", "short text", PROSE, PROSE, PROSE * 40, "# $ % " * 30, "WORD!! OTHER!! " * 20,
    "\n".join(f"line {k % 3} of a list that comes again" for k in range(30)), "same " * 50, "a b c d e f g h a b c d e f g h",
    "a b c d e f g a b c d e f g", "x" * 50_000, " ".join(f"w{k % 4000}" for k in range(9000)),
    "Größe ÄÖÜ ß " * 12, "menu | home | about | help | " * 9, "𝒳𝒴   𝒵 word",
]


def brute_figures(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    windows = collections.Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {i + k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(8)}
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered), "n_lines": len(lines),
        "n_exclaimed": text.count("!"), "n_ends": len(re.findall("[.!?]", text)),
        "n_stutter": sum(a == b for a, b in zip(words, words[1:])),
    }


@pytest.mark.parametrize("hash_of", [F.xxhash64, lambda w: F.length(w).cast("bigint"), lambda w: F.lit(7).cast("bigint")])
def test_quality_figures(spark, hash_of):
    """Also where the hash of a word is so weak that windows of other words share it."""
    df = clashing(spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string").repartition(3))
    for row in rules.figures(df, hash_of=hash_of).collect():
        want = brute_figures(TEXTS[row.doc_id])
        assert {c: row[c] for c in want} == want, row.doc_id


def brute_em(patterns):
    """(quality by pattern) by the same rounds over plain lists."""
    n_rules = len(next(iter(patterns)))
    prior, good, bad = 0.5, [rules.ON_GOOD[0]] * n_rules, [rules.ON_BAD[0]] * n_rules

    def posterior(votes):
        odds = math.log(prior / (1 - prior))
        for v, g, b in zip(votes, good, bad):
            odds += math.log(g / (1 - b)) if v > 0 else math.log((1 - g) / b) if v < 0 else 0
        return 1 / (1 + math.exp(-odds))

    for _ in range(rules.ROUNDS):
        q = {votes: posterior(votes) for votes in patterns}

        def rate(j, sign, weight, bounds):
            right = sum(weight(p, n) for p, n in patterns.items() if p[j] == sign)
            cast = sum(weight(p, n) for p, n in patterns.items() if p[j])
            return max(bounds[1], min(bounds[2], (right + rules.WEIGHT * bounds[0]) / (cast + rules.WEIGHT)))

        prior = (sum(n * q[p] for p, n in patterns.items()) + rules.WEIGHT / 2) / (sum(patterns.values()) + rules.WEIGHT)
        good = [rate(j, 1, lambda p, n: n * q[p], rules.ON_GOOD) for j in range(n_rules)]
        bad = [rate(j, -1, lambda p, n: n * (1 - q[p]), rules.ON_BAD) for j in range(n_rules)]
    return {votes: posterior(votes) for votes in patterns}


def test_quality_posteriors_and_verdicts(spark):
    df = clashing(spark.createDataFrame(list(enumerate(TEXTS)) + [(4, PROSE), (None, PROSE)], "doc_id bigint, text string"))
    got = rules.quality_rules(df).collect()
    assert len(got) == len(TEXTS) + 2
    patterns = collections.Counter(tuple(r.votes) for r in got)
    want = brute_em(patterns)
    for r in got:
        assert r.quality == pytest.approx(want[tuple(r.votes)], abs=1e-9)
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert r.kept == (not r.base_failed and r.quality >= 0.5)
    by_id = {r.doc_id: r for r in got}
    assert by_id[0].n_words == 0 and set(by_id[0].votes) == {0} and not by_id[0].kept
    assert by_id[4].kept and not by_id[7].kept and not by_id[8].kept and not by_id[16].kept


def test_quality_empty_table(spark):
    assert rules.quality_rules(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []


def test_quality_agrees_with_labels(spark):
    """Of labelled documents that pass the base rule, junk goes and good ones stay."""
    folder = "/root/testdata/sf0.01"
    found = rules.quality_rules(table(spark, folder, "documents")).filter("not base_failed").select("doc_id", "kept")
    rows = found.join(table(spark, folder, "labels"), "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int")))
    share = dict(rows.collect())
    assert share[1] >= 0.995 and share[0] <= 0.1


def test_quality_is_native(spark, capsys):
    rules.figures(table(spark, "/root/testdata/sf0.001", "documents")).explain()
    plan = capsys.readouterr().out
    assert not re.search("Python|Arrow|Pandas", plan)


# 12 conversation repair


def brute_repair(rows):
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, hash) by uniform cost search over whole paths."""
    damaged = []
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        damaged += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    damaged.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    turns = {t for t, _, _ in damaged if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    faults = []
    for n, (_, role, text) in enumerate(damaged):
        shown = text.strip(" \t\n\x0b\x0c\r")
        again = (role, text) in [r[1:] for r in damaged[:n]]
        faults.append("B" if not shown else "D" if again else "T" if shown[-1] not in ".!?" else ".")
    initials = [r[1][:1] for r in damaged]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    heap, done = [(0, "", 0, "", ())], {}
    while True:
        cost, audit, at, made, said = heapq.heappop(heap)
        if (at, made[-1:], made != "") in done:
            continue
        done[at, made[-1:], made != ""] = 1
        if at == len(damaged) and re.fullmatch("(s?(ua)+)?", made):
            break
        options = [("I", 3, at, i, f"{'user' if i == 'u' else 'assistant'}:") for i in "ua"]
        if at < len(damaged):
            _, role, text = damaged[at]
            options.append(("D", 4, at + 1, "", None))
            if faults[at] in ".T":
                cut = 3 * (faults[at] == "T")
                options.append(("K", cut, at + 1, role[:1] or "?", f"{role}:{text}"))
                options += [("R", 3 + cut, at + 1, i, f"{'user' if i == 'u' else 'assistant'}:{text}") for i in "ua"]
        for edit, more, then, initial, line in options:
            roles = made + initial
            if re.fullmatch("s?(ua)*u?", roles):
                heapq.heappush(heap, (cost + more, audit + edit, then, roles, said + ((line,) if line is not None else ())))
    digest = hashlib.sha256("\n".join(said).encode()).hexdigest()
    return (gaps, *(faults.count(f) for f in "BDT"), illegal, cost, audit, digest)


def random_conversations(seed, n=120, most=9):
    random.seed(seed)
    rows = []
    for conv in [None, *range(n)]:
        turn = random.choice([None, -3, 0, 0])
        for k in range(random.randint(1, most)):
            role = random.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "User"])
            text = random.choice(["yes.", "no?", "well", "", " \n", None, f"t{k}.", f"t{k}", "Ä!\t", "ends. "])
            rows.append((conv, turn, role, text))
            turn = turn if turn is None or random.random() < 0.1 else turn + random.choice([1, 1, 1, 3])
            if random.random() < 0.1:
                rows.append(rows[-1])
    return rows


CONVERSATIONS = "conv_id bigint, turn bigint, role string, text string"


@pytest.mark.parametrize("piece,fan_in", [(512, 64), (1, 2), (3, 2)])
def test_conversation_repair(spark, piece, fan_in):
    """Whole conversations and ones cut into pieces that combine in several rounds."""
    rows = random_conversations(piece) + [(999, k, "user" if k % 3 else "assistant", f"long {k}" + ". "[k % 2]) for k in range(90)]
    df = clashing(spark.createDataFrame(rows, CONVERSATIONS).repartition(5))
    got = {r[0]: tuple(r)[1:] for r in repair.conversation_repair(df, piece=piece, fan_in=fan_in).collect()}
    by_conv = collections.defaultdict(list)
    for row in rows:
        by_conv[row[0]].append(row)
    assert got.keys() == by_conv.keys()
    for conv, own in by_conv.items():
        assert got[conv] == brute_repair(own), conv


def test_bidirectional_search_takes_the_least_audit():
    for n in range(5):
        for rows in itertools.product([("u", "."), ("a", "T"), ("s", "."), ("u", "B")], repeat=n):
            states, least = {0: (0, "")}, []
            for initial, fault in [*rows, (None, None)]:
                for _ in range(3):
                    for s, (c, a) in list(states.items()):
                        t = repair.NEXT[s][repair.WANTED[s]]
                        states[t] = min(states.get(t, (99, "")), (c + 3, a + "I"))
                if initial is None:
                    least = min(states[s] for s in repair.ENDS if s in states)
                    break
                after = {}
                for s, (c, a) in states.items():
                    for edit, cost, (_, t) in repair._steps([(initial, fault)], 0, s):
                        if edit != "I":
                            after[t] = min(after.get(t, (999, "")), (c + cost, a + edit))
                states = after
            assert repair.cheapest(rows) == least, rows


def test_conversation_without_rows_and_empty_table(spark):
    gone = next(k for k in range(100) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    row = repair.conversation_repair(spark.createDataFrame([(gone, 0, "user", "hi.")], CONVERSATIONS)).first()
    assert tuple(row) == (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert repair.conversation_repair(spark.createDataFrame([], CONVERSATIONS)).collect() == []


def test_conversation_ids_of_other_types(spark):
    df = spark.createDataFrame([("a", 0, "user", "hi."), ("a", 1, "assistant", "x" * 100_000)], CONVERSATIONS.replace("conv_id bigint", "conv_id string"))
    (row,) = repair.conversation_repair(df).collect()
    assert row.conv_id == "a" and row.audit


# 13 centroid clustering


def brute_clusters(rows, k=16, rounds=3, width=64):
    kept = []
    for id_, v in rows:
        if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v):
            kept.append((id_, [math.floor(64 * x) for x in v]))
    if not kept:
        return {}
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))
    centres = [list(p) for _, p in order[:k]]

    def nearest(p):
        return min((sum((a - b) ** 2 for a, b in zip(p, c)), i) for i, c in enumerate(centres))

    for _ in range(rounds):
        members = collections.defaultdict(list)
        for _, p in kept:
            members[nearest(p)[1]].append(p)
        for i, own in members.items():
            centres[i] = [sum(column) // len(own) for column in zip(*own)]
    placed = [(id_, *reversed(nearest(p))) for id_, p in kept]
    inertia = collections.Counter()
    for _, c, d in placed:
        inertia[c] += d
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return collections.Counter((id_, c, d, inertia[c], sum(inertia.values()), names[c]) for id_, c, d in placed)


def vectors(spark, rows):
    return clashing(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").repartition(4))


def test_centroid_clusters(spark):
    rng = np.random.default_rng(13)
    rows = [(k, np.float32(rng.normal(rng.integers(0, 5), 0.4, 64)).tolist()) for k in range(600)]
    rows += [(k + 1000, rows[k % 7][1]) for k in range(60)] + [rows[0], rows[0], (None, rows[3][1]), (2**60, [0.0] * 64)]
    rows += [(700, None), (701, []), (702, [1.0] * 63), (703, [float("nan")] * 64), (704, [None] * 64), (705, [float("inf")] + [0.0] * 63)]
    got = collections.Counter(tuple(r) for r in centroids.centroid_clusters(vectors(spark, rows)).collect())
    assert got == brute_clusters(rows)


def test_centroid_ties_and_few_vectors(spark):
    """Small integers in few dimensions: many equal distances, equal and empty centroids."""
    for seed, n, k in [(1, 200, 7), (2, 5, 16), (3, 1, 16), (4, 40, 1), (5, 30, 3)]:
        rng = np.random.default_rng(seed)
        rows = [(i, (rng.integers(-1, 2, 2) / 64).tolist()) for i in range(n)]
        got = centroids.centroid_clusters(vectors(spark, rows), width=2, k=k).collect()
        assert collections.Counter(tuple(r) for r in got) == brute_clusters(rows, k=k, width=2), seed
    assert centroids.centroid_clusters(vectors(spark, [])).collect() == []


def test_bounds_spare_searches():
    rng = np.random.default_rng(5)
    rows = np.concatenate([rng.integers(-40, 40, (300, 8)) + 400 * c for c in range(6)])
    centres = rows[::300].copy()
    n = len(rows)
    state = np.zeros(n, np.int64), np.ones(n, np.int64), np.full(n, np.inf), np.zeros(n)
    *state, searched = centroids.follow(rows, *state, centroids.Centres(centres, None))
    assert searched.sum() > 0
    moved = centres + rng.integers(-3, 4, centres.shape)
    near, *_, searched = centroids.follow(rows, *state, centroids.Centres(moved, centres))
    assert searched.sum() == 0
    assert (near == ((rows[:, None] - moved[None]) ** 2).sum(2).argmin(1)).all()
