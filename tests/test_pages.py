"""Tables of pages against a brute force that tries all rectangles."""

import random

from pyspark.sql import functions as F

from noticeflow.operators import page_tables as T
from noticeflow.plans import QUERIES
from noticeflow.sources import convert

LINES = "name string, page int, x0 double, x1 double, top double, bottom double"
CHARS = "name string, page int, pos int, text string, x0 double, x1 double, top double, bottom double"


def grid(rng, name, page, left, top):
    """(lines, cells) of a table of random rows and columns, some of its cells over two columns or two rows."""
    xs, ys = [left], [top]
    for _ in range(rng.randint(1, 4)):
        xs.append(xs[-1] + rng.randint(30, 60))
    for _ in range(rng.randint(1, 4)):
        ys.append(ys[-1] + rng.randint(14, 30))
    owner = {(r, c): (r, c) for r in range(len(ys) - 1) for c in range(len(xs) - 1)}
    for r in range(len(ys) - 1):
        for c in range(len(xs) - 1):
            dr, dc = rng.choice([(0, 1), (1, 0), (0, 0), (0, 0)])
            n = (r + dr, c + dc)
            if (dr or dc) and n in owner and owner[n] == n and owner[r, c] == (r, c) and list(owner.values()).count(n) == 1 and list(owner.values()).count((r, c)) == 1:
                owner[n] = (r, c)
    jitter = lambda: rng.choice([-0.5, 0.0, 0.5])
    lines = []
    for (r, c), o in owner.items():
        x0, x1, y0, y1 = xs[c], xs[c + 1], ys[r], ys[r + 1]
        for (nr, nc), line in (((r - 1, c), (x0, x1, y0, y0)), ((r + 1, c), (x0, x1, y1, y1)), ((r, c - 1), (x0, x0, y0, y1)), ((r, c + 1), (x1, x1, y0, y1))):
            if owner.get((nr, nc)) != o:
                d = jitter()
                level = line[2] == line[3]
                a, b, t, u = line
                lines.append((name, page, float(a), float(b), t + d, u + d) if level else (name, page, a + d, b + d, float(t), float(u)))
    rng.shuffle(lines)
    boxes = {}
    for (r, c), o in owner.items():
        b = boxes.get(o, (xs[c], xs[c + 1], ys[r], ys[r + 1]))
        boxes[o] = (min(b[0], xs[c]), max(b[1], xs[c + 1]), min(b[2], ys[r]), max(b[3], ys[r + 1]))
    return lines, sorted(boxes.values(), key=lambda b: (b[2], b[0]))


def brute_cells(lines, tol=T.TOLERANCE):
    """The least rectangle at each corner whose sides are covered by lines, tried one by one."""
    def cluster(vs):
        out = []
        for v in sorted(vs):
            if out and v - out[-1][-1] <= tol:
                out[-1].append(v)
            else:
                out.append([v])
        return {v: sum(g) / len(g) for g in out for v in g}

    level = [x for x in lines if x[3] - x[2] > abs(x[5] - x[4])]
    upright = [x for x in lines if x[5] - x[4] > abs(x[3] - x[2])]
    sy, sx = cluster([(x[4] + x[5]) / 2 for x in level]), cluster([(x[2] + x[3]) / 2 for x in upright])
    hs = [(sy[(x[4] + x[5]) / 2], x[2], x[3]) for x in level]
    vs = [(sx[(x[2] + x[3]) / 2], x[4], x[5]) for x in upright]

    def covered(parts, at, a, b):
        upto = a
        for _, lo, hi in sorted(p for p in parts if p[0] == at):
            if lo - upto <= tol:
                upto = max(upto, hi)
        own = [p for p in parts if p[0] == at and p[1] <= a + tol and p[2] >= a - tol]
        return bool(own) and upto >= b - tol

    ys, xs = sorted({h[0] for h in hs}), sorted({v[0] for v in vs})
    found = []
    for i, y0 in enumerate(ys):
        for j, x0 in enumerate(xs):
            box = next(((x0, x1, y0, y1) for y1 in ys[i + 1 :] for x1 in xs[j + 1 :] if covered(hs, y0, x0, x1) and covered(hs, y1, x0, x1) and covered(vs, x0, y0, y1) and covered(vs, x1, y0, y1)), None)
            if box:
                found.append(box)
    return sorted(found, key=lambda b: (b[2], b[0]))


def letters(name, page, pos, text, x, y):
    return [(name, page, pos + i, c, x + 4.0 * i, x + 4.0 * i + 3.5, float(y), y + 7.0) for i, c in enumerate(text)]


def test_random_pages(spark):
    rng = random.Random(5)
    lines, chars, tables = [], [], {}
    for page in range(25):
        name, own = f"f{page % 3}", []
        for k in range(rng.randint(1, 2)):
            got, boxes = grid(rng, name, page, 20 + 300 * k, 100 + rng.randint(0, 40))
            own += got
            texts = {}
            for n, b in enumerate(boxes):
                word = rng.choice(["ab cd", "x", "", "a b", "한글"])
                chars += letters(name, page, 1000 * k + 50 * n, word, b[0] + 3, b[2] + 4)
                texts[b] = word
            if len(boxes) > 1:
                tables[name, page, boxes[0][2], boxes[0][0]] = (boxes, texts)
        lines += own
        chars += letters(name, page, 9000, f"page {page}", 20, 30)
    found = T.cells(spark.createDataFrame(lines, LINES))
    got = {}
    for r in found.collect():
        got.setdefault((r["name"], r["page"]), []).append(tuple(round(v, 3) for v in (r.x0, r.x1, r.top, r.bottom)))
    for key in {(x[0], x[1]) for x in lines}:
        want = [tuple(round(v, 3) for v in b) for b in brute_cells([x for x in lines if (x[0], x[1]) == key])]
        assert sorted(got.get(key, []), key=lambda b: (b[2], b[0])) == want
    rows = T.table_rows(T.table_cells(found), spark.createDataFrame(chars, CHARS))
    texts = {}
    for r in rows.collect():
        texts.setdefault((r["name"], r["page"]), []).append((r["table"], r["rows"]))
    for key in {k[:2] for k in tables}:
        want = []
        for _, (boxes, words) in sorted((k, v) for k, v in tables.items() if k[:2] == key):
            xs = sorted({b[0] for b in boxes})
            want.append([[next((" ".join(words[b].split()) for b in boxes if (b[2], b[0]) == (y, x)), "") for x in xs] for y in sorted({b[2] for b in boxes})])
        assert [t for _, t in sorted(texts[key])] == want


def test_whole_files(spark):
    lines, chars = [], []
    for page in (1, 2):
        for y in (100.0, 120.0, 140.0):
            lines.append(("a.pdf", page, 20.0, 120.0, y, y))
        for x in (20.0, 70.0, 120.0):
            lines.append(("a.pdf", page, x, x, 100.0, 140.0))
        chars += letters("a.pdf", page, 0, f"Hello page {page}", 20, 20) + letters("a.pdf", page, 50, "next line", 20, 32)
        for k, t in enumerate(("a", "b b", "c", f"d{page}")):
            chars += letters("a.pdf", page, 100 + 10 * k, t, 24 + 50 * (k % 2), 105 + 20 * (k // 2))
    # a stub of a line into a cell and a line alone make no cells; a frame of one cell is no table
    lines += [("a.pdf", 2, 40.0, 40.0, 100.0, 108.0), ("a.pdf", 2, 300.0, 400.0, 10.0, 10.0)]
    lines += [("b.pdf", 1, 10.0, 90.0, 10.0, 10.0), ("b.pdf", 1, 10.0, 90.0, 40.0, 40.0), ("b.pdf", 1, 10.0, 10.0, 10.0, 40.0), ("b.pdf", 1, 90.0, 90.0, 10.0, 40.0)]
    chars += letters("b.pdf", 1, 0, "framed", 15, 20)
    bodies, tables = T.read_pages(spark.createDataFrame(chars, CHARS), spark.createDataFrame(lines, LINES))
    got = {r["name"]: r["text"] for r in convert.page_texts(bodies, tables).collect()}
    assert got["a.pdf"] == "Hello page 1\nnext line\n\nHello page 2\nnext line\n\n[표]\na | b b\nc | d1\n\na | b b\nc | d2"
    assert got["b.pdf"] == "framed"


def test_no_lines(spark):
    chars = spark.createDataFrame([*letters("c", 1, 0, "só text", 10, 10), ("c", 1, 99, None, 1.0, 2.0, 10.0, 17.0)], CHARS)
    bodies, tables = T.read_pages(chars, spark.createDataFrame([], LINES))
    assert bodies.first()["body"] == "só text" and tables.count() == 0
    none = T.table_cells(T.cells(spark.createDataFrame([], LINES)))
    assert T.table_rows(none, chars).count() == 0 and T.page_lines(chars.filter(F.lit(False)), T.table_boxes(none)).count() == 0


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rows_of_tables_broadcast_nothing(spark):
    """A file of lines and characters is small and they are not: what the planner would broadcast passes the driver."""
    assert "Broadcast" not in _plan(QUERIES["page_tables_rows"](spark, "/root/testdata/sf0.001"))
    assert "Broadcast" not in _plan(T.crossings(spark.createDataFrame([], LINES)))


def test_bodies_of_pages_broadcast_nothing(spark):
    assert "Broadcast" not in _plan(QUERIES["page_tables_bodies"](spark, "/root/testdata/sf0.001"))


def test_numbers_of_tables():
    """Cells in order of their upper left corners: a frame, a cell that joins two others later, and one apart."""
    cells = [(0.0, 0.0, 1.0, 1.0), (0.0, 5.0, 1.0, 6.0), (0.0, 7.0, 1.0, 8.0), (1.0, 6.0, 2.0, 7.0), (3.0, 0.0, 4.0, 1.0), (4.0, 1.0, 5.0, 2.0)]
    assert T.table_numbers(cells, 2) == [0, 1, 1, 1, 2, 2] and T.table_numbers(cells, 1) == [1, 2, 2, 2, 3, 3]
