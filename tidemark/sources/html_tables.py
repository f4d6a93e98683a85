"""Tables out of HTML and markdown as rows: a grid with row and column spans, header lines mapped to column names.

Python reads one page at a time inside Spark's tasks; pages are rows, so many pages spread over all tasks.

Rules: a spanned cell's text stands in every place it covers; rowspan="0" reaches to the end of the row group; spans are cut at
1,000 columns and at the end of the table's rows. A nested table is a table of its own and its text is not the outer cell's.
Rows of th cells alone (or in a thead) before the first other row are header lines; a column's name joins its distinct header
texts from top to bottom; columns without one are named c1, c2, … Cells that a row lacks are null, empty cells are ''. Missing
end tags are closed as browsers do (td by td, tr by tr). Null pages and pages without tables have no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MOST_COLUMNS = 1_000
_SPACE = re.compile(r"\s+")
_RULE = re.compile(r"^:?-+:?$")
_PIPE = re.compile(r"(?<!\\)\|")


class _Table:
    def __init__(self) -> None:
        self.rows: list[list[tuple[str, int, int]]] = []  # text, columns, rows of each cell
        self.heads: list[bool] = []
        self.ends: list[int] = []  # for each row, where its group ends (filled when the group closes)
        self.cell: list[str] | None = None
        self.spans, self.in_head, self.group = (1, 1), False, 0

    def open_row(self) -> None:
        self.close_cell()
        self.rows.append([])
        self.heads.append(True)

    def open_cell(self, tag: str, spans: tuple[int, int]) -> None:
        self.close_cell()
        if not self.rows or len(self.rows) == len(self.ends):
            self.open_row()
        self.cell, self.spans = [], spans
        if tag == "td" and not self.in_head:
            self.heads[-1] = False

    def close_cell(self) -> None:
        if self.cell is not None:
            self.rows[-1].append((_SPACE.sub(" ", "".join(self.cell)).strip(), *self.spans))
            self.cell = None

    def close_group(self) -> None:
        self.close_cell()
        self.ends += [len(self.rows)] * (len(self.rows) - len(self.ends))

    def grid(self) -> tuple[list[list[str | None]], int]:
        """The cells by place, and how many of the first rows are header lines."""
        self.close_group()
        out: list[list[str | None]] = []
        above: dict[int, tuple[str, int]] = {}  # column -> text and the row before which its span ends
        for i, row in enumerate(self.rows):
            above = {c: s for c, s in above.items() if s[1] > i}
            line, c = {k: s[0] for k, s in above.items()}, 0
            for text, wide, tall in row:
                while c in line:
                    c += 1
                end = self.ends[i] if tall == 0 else min(i + tall, self.ends[i])
                for k in range(c, min(c + wide, MOST_COLUMNS)):
                    line[k] = text
                    if end > i + 1:
                        above[k] = (text, end)
                c += wide
            out.append([line.get(k) for k in range(max(line, default=-1) + 1)])
        heads = next((i for i, h in enumerate(self.heads) if not h or not self.rows[i]), len(out))
        return out, heads if heads < len(out) else min(heads, 1)


def _number(value: str | None, default: int = 1) -> int:
    return int(value) if value and value.strip().isdigit() else default


class _Reader(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[_Table] = []
        self.done: list[_Table] = []
        self.skip = 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in ("script", "style"):
            self.skip += 1
        if tag == "table":
            self.open.append(_Table())
            self.done.append(self.open[-1])
        if not self.open:
            return
        t = self.open[-1]
        if tag == "tr":
            t.open_row()
        elif tag in ("td", "th"):
            a = dict(attrs)
            t.open_cell(tag, (max(1, min(_number(a.get("colspan")), MOST_COLUMNS)), _number(a.get("rowspan"))))
        elif tag in ("thead", "tbody", "tfoot"):
            t.close_group()
            t.in_head = tag == "thead"
        elif tag in ("br", "p", "div", "li") and t.cell is not None:
            t.cell.append(" ")

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style"):
            self.skip = max(0, self.skip - 1)
        if not self.open:
            return
        t = self.open[-1]
        if tag == "table":
            t.close_group()
            self.open.pop()
        elif tag in ("td", "th", "tr"):
            t.close_cell()
        elif tag in ("thead", "tbody", "tfoot"):
            t.close_group()
            t.in_head = False

    def handle_data(self, data: str) -> None:
        if self.open and self.open[-1].cell is not None and not self.skip:
            self.open[-1].cell.append(data)


def html_grids(html: str) -> list[tuple[list[list[str | None]], int]]:
    r = _Reader()
    r.feed(html)
    r.close()
    return [t.grid() for t in r.done]


def markdown_grids(text: str) -> list[tuple[list[list[str | None]], int]]:
    """Tables of lines that begin with a bar; a second line of dashes makes the first one the header."""
    found, held = [], []
    for line in [*text.splitlines(), ""]:
        line = line.strip()
        if line.startswith("|"):
            cells = _PIPE.split(line[1:-1] if line.endswith("|") and not line.endswith("\\|") and len(line) > 1 else line[1:])
            held.append([c.strip().replace("\\|", "|") for c in cells])
        elif held:
            head = len(held) > 1 and all(_RULE.match(c) for c in held[1])
            found.append(([held[0], *held[2:]] if head else held, int(head)))
            held = []
    return found


def names(grid: list[list[str | None]], heads: int) -> list[str]:
    """A name for each column from its header lines."""
    wide = max(map(len, grid), default=0)
    out = []
    for c in range(wide):
        parts = [row[c] for row in grid[:heads] if c < len(row) and row[c]]
        out.append(" ".join(dict.fromkeys(parts)) or f"c{c + 1}")
    return out


def table_cells(pages: DataFrame, key: str, text: str) -> DataFrame:
    """Every cell of every table: key, table_no, row_no (header lines left out), column_no, header, value. Pages without an HTML
    table are read as markdown."""
    fields = [pages.schema[key], *(T.StructField(n, T.IntegerType()) for n in ("table_no", "row_no", "column_no")), T.StructField("header", T.StringType()), T.StructField("value", T.StringType())]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for k, page in zip(f[key], f[text], strict=True):
                grids = (html_grids(page) or markdown_grids(page)) if isinstance(page, str) else []
                for n, (grid, heads) in enumerate(grids, 1):
                    titles = names(grid, heads)
                    for i, row in enumerate(grid[heads:], 1):
                        out += [(k, n, i, c + 1, title, row[c] if c < len(row) else None) for c, title in enumerate(titles)]
            yield pd.DataFrame(out, columns=[x.name for x in fields]).astype({key: f[key].dtype} if out else {})

    return pages.select(key, text).mapInPandas(run, T.StructType(fields))


def table_rows(cells: DataFrame, key: str, wanted: list[str]) -> DataFrame:
    """The rows of the tables that have all wanted columns, one column for each."""
    by = [key, "table_no"]
    columns = [F.max(F.when(F.col("header") == w, F.col("value"))).alias(w) for w in wanted]
    has = cells.groupBy(*by, "row_no").agg(F.count_if(F.col("header").isin(wanted)).alias("_k"), *columns)
    return has.where(F.col("_k") >= len(wanted)).drop("_k")


def number(value):
    """A table's figure: commas between thousands, brackets for negative numbers, a dash or nothing for zero; else null."""
    v = F.replace(F.trim(value), F.lit(","), F.lit(""))
    inner = F.regexp_extract(v, r"^\((.*)\)$", 1)
    plain = F.when(inner != "", F.concat(F.lit("-"), inner)).otherwise(v)
    return F.when(v.isin("", "-"), F.lit(0.0)).otherwise(plain.try_cast("double"))
