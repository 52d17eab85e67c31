"""Parallel prefixes, machines over lines, markup as rows: against loops and a parser."""

from __future__ import annotations

import random
from html.parser import HTMLParser

from pyspark.sql import functions as F

from tallyforge.operators import machines, markup, prefix


def test_scan_over_several_levels(spark):
    n = 64 * 64 + 130
    rows = spark.range(n).select((F.col("id") % 2).alias("part"), F.floor(F.col("id") / 2).alias("place"), F.col("id").alias("v"))
    one = spark.createDataFrame([(None, 0, 5), (None, 1, 7)], "part long, place long, v long")
    got = prefix.scan(rows.unionByName(one), ["part"], "place", F.col("v"), F.lit(0).cast("long"), lambda a, b: a + b, "s").collect()
    sums = {}
    for r in sorted(got, key=lambda r: (r["part"] is None, r["part"], r["place"])):
        before = sums.get(r["part"], 0)
        sums[r["part"]] = before + r["v"]
        assert (r["s"]["before"], r["s"]["after"]) == (before, before + r["v"])
    assert len(got) == n + 2
    empty = prefix.scan(one.limit(0), ["part"], "place", F.col("v"), F.lit(0).cast("long"), lambda a, b: a + b, "s")
    assert empty.collect() == []


def test_machine_and_carried_values(spark):
    r = random.Random(1)
    table = [[1, 2, 0], [0, 0, 2], [2, 1, 1]]
    rows = [(p, i, r.choice([0, 1, 2, None]), r.choice([None, None, i])) for p in ("a", "b") for i in range(300)]
    df = spark.createDataFrame(rows, "p string, i long, s int, v long")
    got = {(x["p"], x["i"]): x for x in prefix.carried(prefix.machine(df, ["p"], "i", F.col("s"), table), ["p"], "i", F.col("v"), "last").collect()}
    for p in ("a", "b"):
        state, last = 0, None
        for q, i, s, v in rows:
            if q == p:
                before, state = state, state if s is None else table[s][state]
                last = last if v is None else v
                x = got[p, i]
                assert (x["state"]["before"], x["state"]["after"], x["last"]) == (before, state, last)


def test_packed_is_the_greedy_loop(spark):
    r = random.Random(2)
    rows = [("hot" if i % 4 else "x", i, r.choice([0, 1, 5, 9, 30, None])) for i in range(400)] + [(None, 7, 3)]
    for most_rows, most_size in ((4, 20), (1, 5), (7, 1000)):
        got = {(x["p"], x["k"]): x["batch"] for x in prefix.packed(spark.createDataFrame(rows, "p string, k long, s int"), ["p"], "k", "s", most_rows, most_size, rows_per_range=40).collect()}
        now = {}
        for p, k, s in rows:
            batch, n, size = now.get(p, (-1, 0, 0))
            s = s or 0
            batch, n, size = (batch + 1, 1, s) if batch < 0 or n + 1 > most_rows or size + s > most_size else (batch, n + 1, size + s)
            now[p] = batch, n, size
            assert got[p, k] == batch, (most_rows, p, k)


def read_blocks(lines, width=4):
    """One line after the other."""
    out, state, block = [], "ORPHAN", None
    for place, text in lines:
        t = (text or "").strip()
        first = t.split()[0].lower() if t else ""
        if t.startswith("►"):
            block = {"place": place, "name": [t], "v": [], "d": [], "c": [], "early": False}
            out.append(block)
            state = "NAME"
        elif t.startswith("Results"):
            state = "ORPHAN"
        elif first == "value":
            if state in ("NAME", "VALUE"):
                block["v"].append(t.split()[1:])
            state = "VALUE" if state in ("NAME", "VALUE") else "ORPHAN"
        elif first == "date":
            if state == "VALUE":
                block["d"].append(t.split()[1:])
            elif state in ("NAME", "DATE"):
                block["early"] = True
            state = "DATE" if state == "VALUE" else "ORPHAN"
        elif t and state == "NAME":
            block["name"].append(t)
        elif t and state == "DATE":
            block["c"].append(t)
    for b in out:
        problems = [p for c, what in ((b["v"], "values"), (b["d"], "dates")) for p in [f"no {what}" if not c else f"{what} twice" if len(c) > 1 else f"{what} count" if len(c[0]) != width else None] if p]
        one = lambda c: c[0] if len(c) == 1 and len(c[0]) == width else None
        yield b["place"], " ".join(b["name"]), one(b["v"]), one(b["d"]), " ".join(b["c"]) or None, problems + ["date out of place"] * b["early"]


def test_block_readings_of_a_long_document(spark):
    r = random.Random(3)
    texts = ["► A (Number)", "more of it", "Value 1 2 3 4", "Value 1 2", "Date a b c d", "date a b", "Results", "", None, "said", "Values differ"]
    lines = [(i, r.choice(texts)) for i in range(5000)]
    df = spark.createDataFrame([("d", i, 1, t) for i, t in lines] + [("e", 0, 1, "Value 1 2 3 4")], "document_id string, place long, page int, text string").repartition(5)
    got = machines.block_readings(df, "^►", "^Results").orderBy("place").collect()
    assert [(x["place"], x["name"], x["values"], x["dates"], x["comments"], x["problems"]) for x in got] == list(read_blocks(lines))


def test_sections(spark):
    rows = [(0, "run", True, True), (1, "x", False, False), (2, "One", True, False), (3, "y", False, False), (4, " ", True, False), (5, "Two", True, False), (6, "foot", False, True)]
    df = spark.createDataFrame([("d", *r) for r in rows], "document_id string, place long, text string, h boolean, f boolean")
    got = [tuple(x)[-3:] for x in machines.in_sections(df, F.col("h"), F.col("f")).orderBy("place").collect()]
    assert got == [(False, None, None), (False, 0, "FRONT_MATTER"), (True, 1, "One"), (False, 1, "One"), (False, 1, "One"), (True, 2, "Two"), (False, None, None)]


class Cells(HTMLParser):
    """Cells and blocks as the operators define them, one event after the other."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open, self.tables, self.cells, self.blocks = [], 0, {}, [["text", ""]]

    def handle_starttag(self, tag, attrs):
        if tag in markup.BLOCK_TAGS:
            self.blocks.append([tag, ""])
        if tag == "table":
            self.tables += 1
            self.open.append({"no": self.tables, "row": 0, "cell": 0, "in_row": False, "now": None})
        elif self.open:
            t = self.open[-1]
            if tag == "tr":
                t.update(row=t["row"] + 1, cell=0, in_row=True, now=None)
            elif tag in ("td", "th"):
                if not t["in_row"]:
                    t.update(row=t["row"] + 1, cell=0, in_row=True)
                t["cell"] += 1
                t["now"] = (t["no"], t["row"], t["cell"])
                self.cells[t["now"]] = ""
            elif tag in ("tbody", "thead", "tfoot", "caption"):
                t.update(in_row=False, now=None)
            elif tag in markup.BLOCK_TAGS and t["now"]:
                self.cells[t["now"]] += " "

    def handle_endtag(self, tag):
        if tag in markup.BLOCK_TAGS:
            self.blocks.append(["text", ""])
        if tag == "table":
            if self.open:
                self.open.pop()
        elif self.open:
            t = self.open[-1]
            if tag in ("tr", "tbody", "thead", "tfoot", "caption"):
                t.update(in_row=False, now=None)
            elif tag in ("td", "th"):
                t["now"] = None
            elif tag in markup.BLOCK_TAGS and t["now"]:
                self.cells[t["now"]] += " "

    def handle_data(self, data):
        if self.cdata_elem:
            return
        if not self.open:
            self.blocks[-1][1] += data
        elif self.open[-1]["now"]:
            self.cells[self.open[-1]["now"]] += data


PAGES = [
    "<p>a &amp; b<br>c</p> tail <b>x</b>y &lt;tag&gt; &#233;&#x1F600; &nosuch; &euro;",
    "<table><tr><td>1<td>2<tr><td>3</table>",
    "<table><tr><th colspan=2>h</th></tr><tr><td>a<table><tr><td>in</td></tr></table>after</td><td>b</td></tr></table><p>end",
    "</table></td>x<table><td>no row<td>two</tr><td>again<tbody><tr><td>s</tbody></table></table><table><tr></tr><tr><td>t",
    "<!-- <table><td>no --><script>var t='<td>';</script><style>td{}</style><table><caption>cap</caption><tr><td>1<p>2</p>3</td> between <td>4</table>",
    "<table><tr><td title='a>b'>q</td><td title=\"x'y\">r</td></tr>",
    "no markup",
    "",
    None,
    "5 < 6 and <table><tr><td>a < b</td></tr></table>",
]


def squeezed(text):
    return " ".join(text.replace("\xa0", " ").split())


def test_markup_against_a_parser(spark):
    r = random.Random(4)
    bits = ["<table>", "</table>", "<tr>", "</tr>", "<td>", "</td>", "<th>", "<tbody>", "</tbody>", "x", " y ", "<p>", "</p>", "<b>", "</b>", "<br>", "&amp;", "<div>", "<li>", "<!-- c -->"]
    pages = PAGES + ["".join(r.choice(bits) for _ in range(60)) for _ in range(60)]
    df = spark.createDataFrame([*enumerate(pages)], "id int, html string")
    cells, blocks = {}, {}
    for x in markup.cells(df, "id", "html").collect():
        cells.setdefault(x["id"], {})[x["table_no"], x["row_no"], x["cell_no"]] = x["text"]
    for x in markup.blocks(df, "id", "html").orderBy("id", "block_no").collect():
        blocks.setdefault(x["id"], []).append((x["kind"], x["text"]))
    for i, page in enumerate(pages):
        want = Cells()
        want.feed(page or "")
        want.close()
        assert cells.get(i, {}) == {k: squeezed(v) for k, v in want.cells.items()}, page
        assert blocks.get(i, []) == [(k, squeezed(v)) for k, v in want.blocks if squeezed(v)], page


def test_spans_pages_and_rows(spark):
    html = "<div data-page=2><table><tr><th colspan='2'>h<th>i<tr><td rowspan=3>1<td>2<td>&nbsp;</table></div><div data-page=\"3\"><table><td>z"
    df = spark.createDataFrame([(1, html)], "id int, html string")
    got = [tuple(x) for x in markup.cells(df, "id", "html").orderBy("table_no", "row_no", "cell_no").collect()]
    assert got == [(1, 2, 1, 1, 1, 1, True, 2, 1, "h"), (1, 2, 1, 1, 2, 3, True, 1, 1, "i"), (1, 2, 1, 2, 1, 1, False, 1, 3, "1"), (1, 2, 1, 2, 2, 2, False, 1, 1, "2"), (1, 2, 1, 2, 3, 3, False, 1, 1, ""), (1, 3, 2, 1, 1, 1, False, 1, 1, "z")]
    rows = [tuple(x) for x in markup.table_rows(markup.cells(df, "id", "html"), "id").orderBy("table_no", "row_no").collect()]
    assert rows == [(1, 2, 1, 1, ["h", "", "i"]), (1, 2, 1, 2, ["1", "2", ""]), (1, 3, 2, 1, ["z"])]


def test_rows_are_read_in_one_pass(spark):
    """Rows of odd markup as its cells give them, and no window or sort over tokens."""
    r = random.Random(6)
    bits = ["<table>", "</table>", "<tr>", "<td>", "<td colspan=2>", "<th COLSPAN=' 3 '>", "<td colspan=x>", "<td colspan=-1>", "</td>", "x", "<", "&amp;", "<div data-page=4>", "<p data-page='2'>", "<? ?>", "<script><td></script>"]
    pages = PAGES + ["".join(r.choice(bits) for _ in range(60)) for _ in range(60)]
    df = spark.createDataFrame([*enumerate(pages)], "id int, html string")
    order = ["document_id", "page", "table_no", "row_no"]
    want = markup.table_rows(markup.cells(df, "id", "html"), "id").orderBy(*order).collect()
    assert markup.read_rows(df, "id", "html").orderBy(*order).collect() == want and len(want) > 60
    plan = markup.cells(df, "id", "html")._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Sort" not in plan
