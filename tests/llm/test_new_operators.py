"""Toxicity, the leaderboard change feed and conversation repair."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict
from datetime import datetime, timedelta

import duckdb
import pytest
from pyspark.sql import functions as F

from millrace.llm import leaders, queries, repair, toxicity

# Toxicity


@pytest.mark.parametrize(
    ("said", "words"),
    [
        ("You ѕtupіd 1d10t!!", "you stupid idiot"), ("stupid### $$$ to%%%", "stupid to"), ("s.t.u.p.i.d", "stupid"), ("stuuuupid", "stupid"), ("p​athétic", "pathetic"),
        ("in 2024, 100 $5", "in 2024 100 5"), ("tr@sh $cum", "trash scum"), ("ＩＤＩＯＴ", "idiot"), ("", ""), (" \n", ""),
    ],
)
def test_folding(said, words):
    """l and i are one, so are digits and signs for them."""
    assert toxicity.folded(said).split() == words.replace("l", "i").split()


def test_matches_count_once_a_word_and_not_inside_exceptions():
    m = toxicity.Matcher({"idiot": 2.0, "id": 1.0, "c": 3.0}, ["c fish"])
    assert [w for _, w in m.hits(" idiot idiots oidiot c c fish fish ")] == [2.0, 2.0, 3.0]
    assert toxicity.Matcher({}).hits(" a ") == []


BAD = ["grobian", "schurke", "dolt"]


def corpus(n, seed):
    r = random.Random(seed)
    words = [f"w{a}{b}ord" for a in "abcdefghkm" for b in "aeou"]
    out = []
    for i in range(n):
        text = [r.choice(words) for _ in range(r.randint(3, 200))]
        bad = i % 5 == 0
        if bad:
            for _ in range(max(1, len(text) // 30)):
                text.insert(r.randrange(len(text) + 1), r.choice(BAD))
        elif i % 5 == 1:
            text.insert(0, "dolt hook")  # harmless: a phrase of clean texts only
        out.append((i, " ".join(text), int(bad)))
    return out


def test_toxic_texts_are_found_and_clean_ones_left_alone(spark):
    rows = corpus(900, 1)
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows] + [(5000, "GR0BIAN du d0lt", "x"), (5001, None, "x"), (5002, "", "x"), (None, "schurke", "x"), (5003, "w " * 60000 + "wort", "x"), (5003, "twice", "x")], "doc_id long, text string, words string").repartition(4)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(1, None), (None, 1), (3, 7)], "doc_id long, toxic int")
    got = toxicity.score_toxicity(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got)
    by = {r["doc_id"]: r for r in got}
    held = [(y, by[i]["predicted"]) for i, _, y in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(by[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, _, _ in rows)
    assert sum(a == b for a, b in held) / len(held) > 0.97
    assert by[5000]["predicted"] == 1 and by[5001]["predicted"] == by[5002]["predicted"] == by[5003]["predicted"] == 0 and by[None]["predicted"] == 1


def test_held_out_labels_are_never_seen(spark):
    rows = corpus(300, 2)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    held = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    right = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    wrong = spark.createDataFrame([(i, 1 - y if held(i) else y) for i, _, y in rows], "doc_id long, toxic int")
    a, b = ({r["doc_id"]: r["score"] for r in toxicity.score_toxicity(docs, x).collect()} for x in (right, wrong))
    assert a == b
    assert {r["score"] for r in toxicity.score_toxicity(docs, right.limit(0)).collect()} == {0.0}
    assert toxicity.score_toxicity(docs.limit(0), right).count() == 0


def test_the_curve_rises():
    x, p = toxicity.curve([(0, 2, 500), (5, 0, 9), (9, 3, 1), (12, 2, 2), (20, 40, 0)])
    assert x == sorted(x) and p == sorted(p) and p[0] < 0.05 and p[-1] > 0.9


# Leaders


def shop(spark, n, seed):
    r = random.Random(seed)
    start = datetime(2024, 1, 1)
    items = [(i, r.choice([None, 1.0, 2.5, 9.99])) for i in range(40)]
    vendors = [(v, None if v == 3 else r.randrange(3)) for v in range(9)]
    lines = []
    for i in range(n):
        item = r.choice([None, 7, 7, 7, *range(45)])
        lines.append((i // 2, r.choice([1, 2, None]), item, r.choice([0, 0, 0, *range(11), None]), r.choice([None, 1, 3]), r.choice([None, float("nan"), *[round(r.random() * 90, 2)] * 6]), r.choice(["kept", "returned", None]), r.choice([None, *[start + timedelta(days=r.randrange(150))] * 9])))
    lines += lines[: n // 10]
    return (
        spark.createDataFrame(lines, "sale_id long, line_no int, item_id long, vendor_id long, quantity int, amount double, flag string, shipped_at timestamp").withColumn("batch", F.lit(9)).withColumn("s", F.lit("x")),
        spark.createDataFrame(items, "item_id long, price double"),
        spark.createDataFrame(vendors, "vendor_id long, nation_id int"),
    )


def boards(lines, items, vendors):
    """By brute force, a day at a time."""
    price, nation = {i: p for i, p in items}, {v: n for v, n in vendors}
    made = []
    for sale, no, item, vendor, quantity, amount, flag, shipped in lines:
        text = ",".join("" if x is None else str(x) for x in (sale, item, vendor, no))
        h = zlib.crc32(text.encode())
        s = (shipped - datetime(1970, 1, 1)).days if shipped else 19723 + h % 150
        day = s + h % 7 + (20 if h % 5 == 0 else 0)
        money = amount if amount is not None and amount == amount else None
        cents = int(100 * money + 0.5) if money is not None else quantity * int(100 * price[item] + 0.5) if quantity is not None and price.get(item) is not None else 0
        made.append((min(12, 1 + (day - 19723) * 12 // 180), day, s, nation.get(vendor) if item in price else None, item, -cents if flag == "returned" else cents))
    newest, by_day = None, defaultdict(list)
    for b in sorted({m[0] for m in made}):
        for m in made:
            if m[0] == b and m[3] is not None and (newest is None or m[2] + 8 >= newest):
                by_day[m[1]].append(m)
        newest = max([m[2] for m in made if m[0] == b] + [newest or 0])
    sums, before, out = Counter(), defaultdict(dict), []
    for day in sorted(by_day):
        for m in by_day[day]:
            sums[m[3], m[4]] += m[5]
        for n in {k[0] for k in sums}:
            top = sorted((-v, i) for (k, i), v in sums.items() if k == n and v > 0)[:10]
            now = {i: k + 1 for k, (_, i) in enumerate(top)}
            for i in now.keys() | before[n].keys():
                a, b = before[n].get(i), now.get(i)
                if a != b:
                    out.append((n, day, i, by_day[day][0][0], "enter" if a is None else "exit" if b is None else "move", a, b, sums[n, i]))
            before[n] = now
    return sorted(out, key=repr)


def test_leader_changes_by_brute_force(spark):
    lines, items, vendors = shop(spark, 1500, 4)
    columns = ["sale_id", "line_no", "item_id", "vendor_id", "quantity", "amount", "flag", "shipped_at"]
    want = boards(*[[tuple(r) for r in df.collect()] for df in (lines.select(columns), items, vendors)])
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    got = sorted((tuple(r) for r in leaders.leader_changes(lines, items, vendors).collect()), key=repr)
    assert got == want and len(got) > 300
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) == before
    assert not spark.streams.active


def test_no_lines_give_no_changes(spark):
    lines, items, vendors = shop(spark, 20, 4)
    none = leaders.leader_changes(lines.limit(0), items, vendors)
    assert none.count() == 0 and none.columns == ["nation_id", "arrival_day", "item_id", "batch", "change", "old_rank", "new_rank", "revenue"]
    assert leaders.leader_changes(lines, items.limit(0), vendors).count() == 0


def test_a_batch_that_opens_with_leaders_untouched(spark):
    """An item that the batch leaves alone comes back on the board when others fall."""
    day = lambda n: datetime(2024, 1, 1) + timedelta(days=n)
    r = random.Random(0)
    lines = [(i, 1, i, 0, 1, 100.0 + i, "kept", day(0)) for i in range(14)] + [(100 + i, 1, i, 0, 1, 90.0 + i, "returned", day(60 + r.randrange(4))) for i in range(8, 14)]
    df = spark.createDataFrame(lines, "sale_id long, line_no int, item_id long, vendor_id long, quantity int, amount double, flag string, shipped_at timestamp")
    items, vendors = [(i, 1.0) for i in range(14)], [(0, 5)]
    got = sorted((tuple(x) for x in leaders.leader_changes(df, spark.createDataFrame(items, "item_id long, price double"), spark.createDataFrame(vendors, "vendor_id long, nation_id int")).collect()), key=repr)
    assert got == boards(lines, items, vendors)
    assert {x[4] for x in got if x[3] > 2} >= {"enter", "move"}


# Repair

NEXT = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}


def cheapest(rows):
    """Of (role, text, fault) in order: cost, audit and what is put out, by all insertions there."""

    def inserted(best):
        for _ in range(6):
            for p, (cost, audit, out) in list(best.items()):
                for role in ("user", "assistant"):
                    q = NEXT[role[0]].get(p)
                    if q is not None and ((cost + 3, audit + "I") < best[q][:2] if q in best else True):
                        best[q] = (cost + 3, audit + "I", (*out, f"{role}:"))
        return best

    best = {0: (0, "", ())}
    for role, text, fault in rows:
        new = {}
        for p, (cost, audit, out) in inserted(dict(best)).items():
            ways = [(p, cost + 4, "D", out)]
            if fault not in ("blank", "duplicate"):
                cut = 3 * (fault == "truncated")
                ways += [(NEXT.get(role[:1], {}).get(p), cost + cut, "K", (*out, f"{role}:{text}"))]
                ways += [(NEXT[to[0]].get(p), cost + 3 + cut, "R", (*out, f"{to}:{text}")) for to in ("user", "assistant")]
            for q, c, letter, o in ways:
                if q is not None and (q not in new or (c, audit + letter) < new[q][:2]):
                    new[q] = (c, audit + letter, o)
        best = new
    best = inserted(dict(best))
    return min((best[q] for q in (0, 3) if q in best), key=lambda x: x[:2])


def mended(turns, damage):
    by = defaultdict(list)
    said = lambda v: " " if v is None else str(v)
    for conv, turn, role, text in turns:
        rows, role, text = by[conv], said(role), said(text)
        k = zlib.crc32(f"{said(conv)}:{said(turn)}".encode()) % 20 if damage else 9
        if k:
            text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
            rows += [(turn, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    out = {}
    for conv, rows in by.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, n, marked = set(), Counter(), []
        for _, role, text in rows:
            ink = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = "blank" if not ink else "duplicate" if (role, text) in seen else "truncated" if ink[-1] not in ".!?" else ""
            seen.add((role, text))
            n[fault] += 1
            marked.append((role, text, fault))
        turns_ = [r[0] for r in rows if r[0] is not None]
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
        cost, audit, put = cheapest(marked)
        out[conv] = (max(turns_) - min(turns_) + 1 - len(set(turns_)) if turns_ else 0, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, "\n".join(put))
    return out


def conversations(n, seed, longest=9):
    r = random.Random(seed)
    texts = ["Fine.", "cut off", "", " \n", "Well?", "Fine.", "no end。", "x! \t", None]
    rows = []
    for c in range(n):
        for t in range(r.randint(1, longest)):
            rows.append((None if c == 0 else c, r.choice([t, t, t, t, None, t + 1, 3]), r.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "User"]), r.choice(texts)))
    return rows + rows[:5]


@pytest.mark.parametrize("damage", [True, False])
def test_repair_by_brute_force(spark, damage):
    turns = conversations(150, 8)
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumns({"pos": F.lit("x"), "seg": F.lit(1), "n": F.lit(2)}).repartition(3)
    got = {r["conv_id"]: tuple(r)[1:] for r in repair.repair(df, damage).collect()}
    assert got == mended(turns, damage)


def test_pieces_of_long_conversations_add_up(spark, monkeypatch):
    monkeypatch.setattr(repair, "PIECE", 4)
    monkeypatch.setattr(repair, "BATCH", 16)
    turns = conversations(12, 3, longest=150)
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    assert {r["conv_id"]: tuple(r)[1:] for r in repair.repair(df).collect()} == mended(turns, True)


def test_repair_of_nothing_and_of_long_texts(spark):
    df = spark.createDataFrame([(1, 0, "user", "x" * 300_000 + "."), (1, 1, "assistant", "y" * 300_000 + "!")], "conv_id long, turn long, role string, text string")
    r = repair.repair(df, damage=False).first()
    assert (r["cost"], r["audit"], len(r["repaired"])) == (0, "KK", 600_018)
    assert repair.repair(df.limit(0)).count() == 0


def test_the_queries_and_their_sql(spark, sf_dir):
    con = duckdb.connect()
    for t in ("conversations", "sale_lines", "items", "vendors"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    for name in ("op12_leader_changes", "op13_repair_conversations"):
        got = queries.QUERIES[name](spark, sf_dir)
        want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({queries.ORACLES[name]})").fetchall()
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert {hashlib.sha256(b"").hexdigest()} >= {r[0] for r in con.execute(f"SELECT repaired_sha256 FROM ({queries.ORACLES['op13_repair_conversations']}) WHERE audit = ''").fetchall()}
