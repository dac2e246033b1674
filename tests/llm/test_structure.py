"""Structure repair, mixing and the prefix trie against brute force, with nulls, ties, repeats, long conversations and clashing names."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quakespark.llm import mixing, repair, trie
from quakespark.llm.common import ascii_words
from quakespark.llm.ordered import running

TURNS = "conv_id long, turn long, role string, text string, place string, state string"
GRAMMAR = re.compile(r"(s?(ua)+)?\Z")


def conversations(seed=3, n=60):
    rng = random.Random(seed)
    rows = []
    for c in [*range(n), *range(100, 100 + n), 205, -7]:
        for t in range(rng.randint(0, 7)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            text = rng.choice(["Yes.", "No!", "Why?", "cut", " \t", "", None, "a.b!c?", f"own {c} {t}."])
            rows.append((c, rng.choice([t, t, t, t + 3, None]), role, text))
    rows += [(7, 1, "user", "again."), (7, 1, "user", "again."), (None, 0, "user", "Nobody."), (None, None, None, None)]
    rows += [(900, t, "user" if t % 2 == 0 else "assistant", f"long {t}.") for t in range(300)]
    return [(*r, "p", "s") for r in rows]


def damaged(rows):
    out = defaultdict(list)
    for c, t, role, text, *_ in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = (" " if role is None else role), (" " if text is None else text)
        own = out[c]
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        own += [(t, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return {c: sorted(v, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])) for c, v in out.items()}


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        words = re.sub(r"[\x20\x09-\x0D]", "", text)
        out.append("blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def step_options(rows, found, i):
    _, role, text = rows[i]
    yield "D", 2, None
    if found[i] not in ("blank", "duplicate"):
        more = 5 * (found[i] == "truncated")
        yield "K", more, (role, text)
        for r in ("user", "assistant"):
            yield "R", 1 + more, (r, text)


def cheapest(rows):
    """Keeps the least (cost, audit) of every roles-so-far of the last three rows, with whole strings: no automaton, no ranks."""
    found = faults(rows)
    best = {("", "", ()): 0}
    puts = [(), ("user",), ("assistant",), ("user", "assistant"), ("assistant", "user")]
    for i in range(len(rows) + 1):
        new = {}
        for (roles, audit, out), cost in best.items():
            for put in puts:
                for letter, price, turn in step_options(rows, found, i) if i < len(rows) else [("", 0, None)]:
                    own = [*((r, "") for r in put), *([turn] if turn else [])]
                    shown = roles + "".join(r[:1] or "?" for r, _ in own)
                    if not re.match(r"(s?(ua)*u?)?\Z", shown):
                        continue
                    key = ("s" if shown == "s" else "") + ("u" if shown.endswith("u") else "a" if shown else "")
                    offer = (cost + price + 5 * len(put), audit + "I" * len(put) + letter, shown, out + tuple(own))
                    if key not in new or offer[:2] < new[key][:2]:
                        new[key] = offer
        best = {(s, a, o): c for c, a, s, o in new.values()}
    offers = [(c, a, o) for (s, a, o), c in best.items() if GRAMMAR.match(s)]
    cost, audit, out = min(offers, key=lambda x: x[:2])
    return cost, audit, hashlib.sha256("\n".join(f"{r}:{x}" for r, x in out).encode()).hexdigest(), out


def exhaustive(rows):
    found, offers = faults(rows), []
    puts = [(), ("user",), ("assistant",), ("user", "assistant"), ("assistant", "user")]
    for gaps in itertools.product(puts, repeat=len(rows) + 1):
        for own in itertools.product(*(list(step_options(rows, found, i)) for i in range(len(rows)))):
            turns, cost, audit = [], 0, ""
            for i, put in enumerate(gaps):
                turns += [(r, "") for r in put]
                cost, audit = cost + 5 * len(put), audit + "I" * len(put)
                if i < len(own):
                    cost, audit, turns = cost + own[i][1], audit + own[i][0], turns + ([own[i][2]] if own[i][2] else [])
            if GRAMMAR.match("".join(r[:1] or "?" for r, _ in turns)):
                offers.append((cost, audit))
    return min(offers)


def expected(rows, known):
    want = {}
    by = damaged(rows)
    for c in known:
        own = by.get(c, [])
        found = faults(own)
        turns = [t for t, _, _ in own if t is not None]
        cost, audit, digest, _ = cheapest(own)
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(own))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        want[c] = (gaps, *(found.count(x) for x in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest)
    return want


@pytest.fixture(scope="module")
def turns(spark):
    return spark.createDataFrame(conversations(), TURNS).repartition(5).cache()


def test_repair_equals_brute_force(spark, turns):
    rows = conversations()
    short = [v for v in damaged(rows).values() if 0 < len(v) <= 3]
    assert len(short) > 10 and all(cheapest(v)[:2] == exhaustive(v) for v in short[:12])
    got = {r["conv_id"]: tuple(r)[1:9] for r in repair.repair_report(repair.damage(turns)).collect()}
    assert got == expected(rows, {r[0] for r in rows})
    assert got[900][6].count("K") > 200
    assert repair.repair_report(repair.damage(turns.limit(0))).count() == 0


def test_repair_at_other_prices(monkeypatch):
    monkeypatch.setitem(repair.COSTS, "D", 9)
    monkeypatch.setitem(repair.COSTS, "R", 20)
    monkeypatch.setattr(repair.Repair, "tables", {})
    own = repair.Repair()
    for turn, role in enumerate(["user", "user", "assistant"]):
        own.read(turn, role, f"{turn}.", False, False)
    assert own.ended() == (5, "KIKK", "uaua", hashlib.sha256(b"user:0.\nassistant:\nuser:1.\nassistant:2.").hexdigest())


def test_repaired_turns(spark, turns):
    hurt = repair.damage(turns)
    got = defaultdict(list)
    for r in sorted(repair.repaired_turns(hurt).collect(), key=lambda r: r["place"]):
        got[r["conv_id"]].append((r["role"], r["text"]))
    want = {c: list(cheapest(v)[3]) for c, v in damaged(conversations()).items()}
    assert dict(got) == {c: v for c, v in want.items() if v}


def plain_trie(rows, share=True):
    own = defaultdict(list)
    for c, t, role, text, *_ in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, role or "", text or ""))
    own = {c: [r[2:] for r in sorted(v)] for c, v in own.items()}
    whole = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 6 if share else 0
        base = own.get(c - (c % 100 if c >= 0 else -(-c % 100)), [])
        whole[c] = tuple(base[:h] + v[h:])
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(whole):
        for d in range(len(whole[c]) + 1):
            members[whole[c][:d]].append(c)
        ends[whole[c]].append(c)
    children = Counter(k[:-1] for k in members if k)
    leaves, saved = Counter(), Counter()
    for k, m in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += not children[k]
            saved[k[:d]] += (len(m) - 1) * len(k[-1][1]) if k else 0
    return Counter(
        (m[0], len(k), members[k[:-1]][0] if k else None, len(m), children[k], leaves[k], saved[k], hashlib.sha256(",".join(map(str, ends.get(k, []))).encode()).hexdigest())
        for k, m in members.items()
    )


def test_trie_equals_brute_force(spark, turns):
    rows = conversations()
    assert Counter(map(tuple, trie.rebuilt_trie(turns).collect())) == plain_trie(rows)
    assert Counter(map(tuple, trie.conversation_trie(turns).collect())) == plain_trie(rows, share=False)
    assert trie.rebuilt_trie(turns.limit(0)).count() == 0


def test_trie_of_equal_conversations(spark, monkeypatch):
    monkeypatch.setattr(trie, "RUN", 7)  # ids of a node are hashed over several lists
    rows = [(c, t, "user", "é" * t, "p", "s") for c in range(1000, 1040) for t in range(3)]
    df = spark.createDataFrame(rows, TURNS).repartition(3)
    assert Counter(map(tuple, trie.conversation_trie(df).collect())) == plain_trie(rows, share=False)


def test_running_totals_in_order(spark):
    rng = random.Random(1)
    rows = [(rng.choice("aab"), rng.randint(0, 50), i) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, x int, __part int").repartition(7)
    got = sorted((r["g"], r["x"], r["__part"], r["sum"]) for r in running(df, ["g"], [F.col("x"), F.col("__part")], {"sum": F.col("x")}).collect())
    want, sums = [], Counter()
    for g, x, i in sorted(rows):
        want.append((g, x, i, sums[g]))
        sums[g] += x
    assert got == sorted(want)


def naive_targets(sizes):
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    rest, target, free = 1.5 * sum(sizes.values()), {}, set(order)
    while free:
        level = rest / sum(weight[s] for s in free)
        full = {s for s in free if level * weight[s] > 2 * sizes[s]}
        for s in full or free:
            target[s] = 2.0 * sizes[s] if full else level * weight[s]
        rest -= sum(target[s] for s in full)
        free = free - full if full else set()
    return target


def test_mix(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice([None, "", " \t", "one", "a b  c\n" * rng.randint(1, 90)]), rng.choice(["x", "x", "x", "é", "z", "", None, "\U0001F600", "￿"]), "k") for i in range(900)]
    rows += [(None, "no id", "x", "k"), (None, "no id", "x", "k"), (1, "repeated id", "z", "k"), (1, "repeated id", "z", "k"), (5000, None, "empty source", "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, key string").repartition(4).cache()
    size = lambda x: len(ascii_words(x or ""))
    totals = Counter()
    for _, x, s, _ in rows:
        totals[s] += size(x)
    target = naive_targets(dict(totals))
    assert abs(sum(target.values()) - 1.5 * sum(totals.values())) < 1e-6
    got = mixing.mix_report(docs).collect()
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((i, size(x)) for i, x, _, _ in rows)
    copies, taken, longest = mixing.sampled(docs).collect(), Counter(), Counter()
    for r in copies:
        s = r["row"]["source"]
        assert r["source_size"] == totals[s] and abs(r["target"] - target[s]) < 1e-6 and 0 <= r["copies"] <= 2
        taken[s] += r["copies"] * r["size"]
        longest[s] = max(longest[s], r["size"])
    assert all(abs(taken[s] - target[s]) <= 2 * longest[s] + 1 for s in totals)
    assert Counter((r["row"]["doc_id"], r["copies"] * r["size"]) for r in copies) == Counter((r["doc_id"], r["taken"]) for r in got)
    assert Counter(map(tuple, mixing.mix_report(docs.repartition(9)).collect())) == Counter(map(tuple, got))
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r["copies"] for r in copies)
    assert mixing.mix_report(docs.limit(0)).count() == 0
    nothing = mixing.mix_report(docs.where("source = 'empty source'")).collect()
    assert [tuple(r) for r in nothing] == [(5000, 0, 0, 0.0, 0)]
