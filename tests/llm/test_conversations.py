"""Repair of conversations against a plain search over all edits."""

import hashlib
import heapq
import random
import re
import zlib

from harrow.llm.conversations import cheapest_edits, damaged, repaired, reports

FOLLOWS = {"": "u", "s": "u", "u": "a", "a": "u"}


def plain(codes):
    """Least (cost, audit) by Dijkstra over whole audits."""
    heap, done = [(0, "", 0, "")], set()
    while heap:
        cost, audit, row, last = heapq.heappop(heap)
        if row == len(codes) and last in ("", "a"):
            return cost, audit
        if (row, last) in done:
            continue
        done.add((row, last))
        heapq.heappush(heap, (cost + 5, audit + "I", row, FOLLOWS[last]))
        if row == len(codes):
            continue
        code = codes[row]
        heapq.heappush(heap, (cost + 2, audit + "D", row + 1, last))
        if code != "x":
            more = 5 if code.isupper() else 0
            own = code.lower()
            if own in "ua" and FOLLOWS[last] == own or own == "s" and last == "":
                heapq.heappush(heap, (cost + more, audit + "K", row + 1, own))
            heapq.heappush(heap, (cost + 1 + more, audit + "R", row + 1, FOLLOWS[last]))


def test_least_audit_of_the_cheapest():
    rng = random.Random(5)
    cases = ["", "s", "u", "a", "x", "su", "ua", "sua", "uaua", "us", "o", "O", "UA", "sxua"]
    cases += ["".join(rng.choices("suaoSUAOx", weights=(2, 9, 9, 1, 1, 2, 2, 1, 2), k=rng.randint(1, 12))) for _ in range(1500)]
    cases += ["".join(rng.choices("suaoSUAOx", k=rng.choice((31, 32, 33, 64, 65, 100)))) for _ in range(60)]
    for codes in cases:
        assert cheapest_edits(codes) == plain(codes), codes


def test_long_conversations_are_priced_in_blocks():
    codes = "".join(random.Random(1).choices("suaUAx", k=20_000))
    cost, audit = cheapest_edits(codes)
    assert audit.count("D") + audit.count("K") + audit.count("R") == len(codes) and cost > 0


def by_hand(rows):
    """The report of damaged rows (conv, turn, role, text), by definition."""
    out = {}
    ids = {r[0] for r in rows}
    kept = []
    for conv, turn, role, text in rows:
        case = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if case == 0:
            continue
        text = "" if case == 1 else re.sub("[.!?]", "", text) if case == 2 else text
        role = "user" if case == 4 else role
        kept += [(conv, turn, role, text)] * (2 if case == 3 else 1)
    for conv in ids:
        own = sorted((r for r in kept if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(f"{len(r[2])}:{r[2]}{r[3]}".encode()).digest()))
        turns = [r[1] for r in own if r[1] is not None]
        blank = duplicate = truncated = illegal = 0
        seen, codes = set(), ""
        for k, (_, _, role, text) in enumerate(own):
            body = text.strip(" \t\n\x0b\x0c\r")
            again = (role, text) in seen
            seen.add((role, text))
            blank += not body
            duplicate += bool(body) and again
            cut = bool(body) and not again and body[-1] not in ".!?"
            truncated += cut
            letter = role[:1] if role[:1] in ("s", "u", "a") else "o"
            codes += "x" if not body or again else letter.upper() if cut else letter
            illegal += k > 0 and own[k - 1][2][:1] + role[:1] not in ("su", "ua", "au")
        cost, audit = plain(codes)
        lines, last, at = [], "", 0
        names = {"u": "user", "a": "assistant"}
        for letter in audit:
            if letter == "I":
                last = FOLLOWS[last]
                lines.append(names[last] + ":")
                continue
            _, _, role, text = own[at]
            at += 1
            if letter == "D":
                continue
            last = role[0] if letter == "K" else FOLLOWS[last]
            lines.append((role if letter == "K" else names[last]) + ":" + text)
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, blank, duplicate, truncated, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def test_damaged_rows_against_the_definition(spark):
    rng = random.Random(2)
    texts = ["Hello there.", "Yes!", "no end", "", None, "  \n ", "Same.", "Ends. \n", "Ünïcödé?", "long " * 3000 + "."]
    rows = []
    for conv in [None, *range(150)]:
        for turn in range(rng.randint(1, 9)):
            t = None if rng.random() < 0.05 else turn if rng.random() < 0.9 else turn - 1
            rows.append((conv, t, rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, ""]), rng.choice(texts)))
    rows += rows[:20]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, present string, case int").repartition(5)
    got = {r.conv_id: tuple(r[1:]) for r in reports(damaged(df.drop("present")), present="present").collect()}
    assert got == by_hand(rows)
    other = damaged(df, present="__there")
    assert {r.conv_id: tuple(r[1:]) for r in reports(other, present="__there").collect()} == got


def test_repaired_turns_and_empty_table(spark):
    rows = [(1, 0, "assistant", "Hi."), (1, 1, "user", "What?"), (1, 2, "assistant", "This."), (2, 5, "user", "Only a question?"), (3, 0, "user", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {}
    for r in repaired(df).orderBy("conv_id", "place").collect():
        got.setdefault(r.conv_id, []).append((r.edit, r.turn, r.role, r.text))
    assert got == {1: [("K", 1, "user", "What?"), ("K", 2, "assistant", "This.")]}
    audits = {r.conv_id: (r.cost, r.audit) for r in reports(df).collect()}
    assert audits == {1: (2, "DKK"), 2: (2, "D"), 3: (2, "D")}
    assert reports(df.limit(0)).count() == 0 and repaired(df.limit(0)).count() == 0 and damaged(df.limit(0)).count() == 0
