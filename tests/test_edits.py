"""Places through edits, against texts that are edited one character at a time."""

import random

from plumbline.operators import edits

ALPHABET = "ab é日\U0001f600\n"


def scenario(seed):
    rng = random.Random(seed)
    texts, steps, places, final = {}, [], [], {}
    for t in range(6):
        text = "".join(rng.choices(ALPHABET, k=rng.randint(0, 120)))
        texts[t] = now = text
        for batch in range(3):
            cuts = sorted(rng.sample(range(len(now) + 1), min(len(now) + 1, 2 * rng.randint(0, 5))))
            made = [(a, b, "".join(rng.choices(ALPHABET, k=rng.randint(0, 6)))) for a, b in zip(cuts[::2], cuts[1::2])]
            steps += [(t, batch, a, b, new) for a, b, new in made]
            for a, b, new in sorted(made, reverse=True):
                now = now[:a] + new + now[b:]
        final[t] = now
        places += [(t, p) for p in range(len(text) + 1)]
    return texts, steps, places, final


def moved(place, made):
    """A place through one batch, edit by edit from the last one."""
    for a, b, new in sorted(made, reverse=True):
        if place >= b:
            place += len(new) - (b - a)
        elif place >= a:
            place = a + min(place - a, len(new))
    return place


def test_texts_and_places_through_batches(spark):
    texts, steps, places, final = scenario(1)
    given = spark.createDataFrame(list(texts.items()), "path int, text string")
    told = spark.createDataFrame(steps, "path int, batch int, start long, end long, new string")
    assert {r["path"]: r["text"] for r in edits.edited(given, told, "path").collect()} == final

    spans = spark.createDataFrame([(t, n, a, b, len(new)) for t, n, a, b, new in steps], "path int, batch int, start long, end long, length long")
    points = spark.createDataFrame([(t, p, p) for t, p in places], "path int, first long, at long")
    for size in (200_000, 25):
        got = {(r["path"], r["first"]): r["at"] for r in edits.through(points, spans, "path", "at", size=size).collect()}
        want = {}
        for t, p in places:
            now = p
            for n in range(3):
                now = moved(now, [(a, b, new) for k, m, a, b, new in steps if k == t and m == n])
            want[t, p] = now
        assert got == want
    # A place that no edit holds comes back to where it was.
    there = edits.through(points, spans, "path", "at")
    back = edits.through(there, spans, "path", "at", back=True).collect()
    first = {t: min((a for k, n, a, b, _ in steps if k == t), default=10**9) for t in texts}
    assert all(r["at"] == r["first"] for r in back if r["first"] < first[r["path"]])
    kept = [r for r in back if r["at"] == r["first"]]
    assert len(kept) > len(places) / 2


def test_one_text_of_many_edits(spark):
    spans = spark.range(5000).selectExpr("1 as path", "id * 10 as start", "id * 10 + 3 as end", "id % 5 as length")
    points = spark.createDataFrame([(1, p) for p in (0, 9, 25_004, 49_999, 60_000)], "path int, at long")
    got = [r["at"] for r in edits.mapped(points, spans, "path", "at", size=300).orderBy("at").collect()]
    want = sorted(moved(p, [(i * 10, i * 10 + 3, "x" * (i % 5)) for i in range(5000)]) for p in (0, 9, 25_004, 49_999, 60_000))
    assert got == want


def test_lines_columns_and_back(spark):
    text = "a\U0001f600é\r\n\n日本 x\nlast"
    given = spark.createDataFrame([(1, text), (2, "")], "path int, text string")
    points = spark.createDataFrame([(1, p) for p in range(len(text) + 3)] + [(2, 0)], "path int, at long")
    for r in edits.positions(points, given, "path", "at").collect():
        head = text[: r["at"]] if r["path"] == 1 else ""
        row = head.split("\n")[-1].rstrip("\r")
        assert (r["line"], r["byte_column"], r["utf16_column"]) == (head.count("\n"), len(row.encode()), len(row.encode("utf-16-le")) // 2), r
    places = [(1, 0, c) for c in range(7)] + [(1, 1, 0), (1, 1, 4), (1, 2, 1), (1, 3, 99), (2, 0, 0)]
    got = {(r["path"], r["line"], r["utf16_column"]): r["offset"] for r in edits.offsets(spark.createDataFrame(places, "path int, line int, utf16_column int"), given, "path").collect()}
    # The second unit of a pair lies in its character, so the place is the one before it.
    assert got == {(1, 0, 0): 0, (1, 0, 1): 1, (1, 0, 2): 1, (1, 0, 3): 2, (1, 0, 4): 3, (1, 0, 5): 3, (1, 0, 6): 3, (1, 1, 0): 5, (1, 1, 4): 5, (1, 2, 1): 7, (1, 3, 99): len(text), (2, 0, 0): 0}
