"""Broker reports (HTML, CSV, XLSX) as bronze ledgers.

Files come through Spark's `binaryFile` reader, one row each, so any store that Spark reads will do; a file
is parsed where it lies, in an Arrow batch, and becomes rows of texts. Columns of CSV and XLSX files that no alias
names are kept in `extras`, JSON text with sorted names, so that rows that differ in them stay apart and rejects have
them; those of HTML are dropped.
"""

from __future__ import annotations

import csv
import io
import json
import re
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.parsing import header, header_of
from .adapters import CANONICAL, TEXT_FIELDS

# Headers of HTML reports, by canonical column.
HTML_HEADERS = {
    "position_id": ("position", "position id", "positionid"),
    "deal_id": ("deal", "deal id", "dealid", "order id", "orderid"),
    "symbol": ("symbol", "instrument", "pair", "asset", "ticker"),
    "timestamp": ("time", "close time", "closing time", "date", "datetime", "exit time"),
    "side": ("type", "direction", "side", "action"),
    "quantity": ("volume", "size", "lots", "qty", "amount", "units"),
    "entry_price": ("open price", "open", "entry", "price in", "buy price"),
    "exit_price": ("close price", "close", "exit", "price out", "sell price"),
    "gross_pnl": ("gross p&l", "gross pl", "gross profit", "gross"),
    "commission": ("commission", "comm"),
    "swap": ("swap", "rollover"),
    "pnl": ("net p&l", "net pl", "net profit", "profit", "p&l", "pl", "realized pnl"),
    "balance": ("balance",),
}
# Headers of CSV and XLSX files, by canonical column.
TABLE_HEADERS = {
    "timestamp": ("timestamp", "time", "date", "datetime", "open_time", "close_time", "exit_time"),
    "symbol": ("symbol", "pair", "instrument", "asset", "ticker"),
    "side": ("side", "direction", "action", "type"),
    "quantity": ("quantity", "qty", "size", "amount", "units", "volume", "lots"),
    "entry_price": ("entry_price", "open", "price_in", "buy_price", "entry"),
    "exit_price": ("exit_price", "close", "price_out", "sell_price", "exit"),
    "pnl": ("pnl", "profit", "profit_loss", "pl", "realized_pnl", "net_pnl"),
    "gross_pnl": ("gross_pnl", "gross_profit", "gross_pl", "gross"),
    "commission": ("commission", "fees", "cost"),
    "swap": ("swap", "rollover"),
    "balance": ("balance", "equity", "account_value"),
    "position_id": ("position_id", "positionid", "position"),
    "deal_id": ("deal_id", "dealid", "deal", "order_id", "orderid"),
}
# Words that tell a header row, in two groups for a repeated one, and delimiters of CSV files.
HEADER_WORDS = ("symbol", "time", "price", "profit", "balance", "volume", "position", "deal")
NAME_WORDS, VALUE_WORDS = ("symbol", "position", "deal"), ("time", "close", "profit", "price")
DELIMITERS = ",;\t|"


def canonical_html(name: str) -> str | None:
    key = header(name)
    return next((c for c, names in HTML_HEADERS.items() if key in names), None)


def canonical_table(name: str) -> str | None:
    key = name.strip().lower()
    return next((c for c, names in TABLE_HEADERS.items() if key in names), None)


def _looked_up(headers: dict[str, tuple[str, ...]], key: Column) -> Column:
    pairs = [x for c, names in headers.items() for n in names for x in (F.lit(n), F.lit(c))]
    return F.element_at(F.create_map(*pairs), key)


def canonical_html_of(name: Column) -> Column:
    """canonical_html of a column of headers."""
    return _looked_up(HTML_HEADERS, header_of(name))


def canonical_table_of(name: Column) -> Column:
    """canonical_table of a column of headers."""
    return _looked_up(TABLE_HEADERS, F.lower(F.regexp_replace(name, r"^\s+|\s+$", "")))


def format_of(path: Column, content: Column) -> Column:
    """html, csv or xlsx, by the name's ending, else html where the first byte that is no blank is `<`, however many
    blanks or lines come before; a byte order mark may come first."""
    ending = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    tagged = F.decode(content, "ISO-8859-1").rlike(r"^(?:\xEF\xBB\xBF)?[\x09-\x0D\x20]*+<")
    return F.when(ending.isin("html", "htm"), "html").when(ending == "csv", "csv").when(ending.isin("xlsx", "xlsm"), "xlsx").otherwise(F.when(tagged, "html").otherwise("csv"))


def files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of the files under `path`."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def file_info(found: DataFrame) -> DataFrame:
    """(path, format, sha256, size) of files."""
    return found.select("path", format_of(F.col("path"), F.col("content")).alias("format"), F.sha2("content", 256).alias("sha256"), F.length("content").alias("size"))


# ---- HTML


class _Tables(HTMLParser):
    """Tables of a page: class, and rows of (section, [(tag, text)])."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tables: list[dict] = []
        self.open: list[dict] = []
        self.cell: list[str] | None = None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "table":
            self.open.append({"class": (dict(attrs).get("class") or "").lower(), "rows": [], "section": ""})
            self.tables.append(self.open[-1])
        elif self.open and tag in ("thead", "tbody", "tfoot"):
            self._end_cell()
            self.open[-1]["section"] = tag
            self.open[-1].setdefault("bodies", 0)
            self.open[-1]["bodies"] += tag == "tbody"
        elif self.open and tag == "tr":
            self._end_cell()
            t = self.open[-1]
            t["rows"].append((t["section"], t.get("bodies", 0), []))
        elif self.open and tag in ("td", "th") and self.open[-1]["rows"]:
            self._end_cell()
            self.cell = []
            self.open[-1]["rows"][-1][2].append((tag, self.cell))

    def handle_endtag(self, tag: str) -> None:
        if tag in ("td", "th", "tr"):
            self._end_cell()
        elif tag in ("thead", "tbody", "tfoot") and self.open:
            self.open[-1]["section"] = ""
        elif tag == "table" and self.open:
            self._end_cell()
            self.open.pop()

    def handle_data(self, data: str) -> None:
        if self.cell is not None and data.strip():
            self.cell.append(data.strip())

    def _end_cell(self) -> None:
        self.cell = None

    def read(self, text: str) -> None:
        """Feeds a page; runs of plain rows are cut at their tags at once where they stand in a table and in nothing else that is open."""
        at = 0
        for run in _PLAIN_ROWS.finditer(text):
            self.feed(text[at : run.start()])
            at = run.end()
            # text left over is a tag or comment not closed yet, or the beginning of a reference
            if self.rawdata or self.cdata_elem is not None or not self.open:
                self.feed(run[0])
                continue
            self._end_cell()
            t = self.open[-1]
            place = t["section"], t.get("bodies", 0)
            for row in run[0].split("</tr>")[:-1]:
                t["rows"].append((*place, [("td", [x] if (x := cell.strip()) else []) for cell in row.lstrip()[8:-5].split("</td><td>")]))
        self.feed(text[at:])


#: Rows of plain cells, without attributes, references or blanks between the cells' tags.
_PLAIN_ROWS = re.compile(r"(?:<tr>(?:<td>[^<&]*+</td>)++</tr>\s*+){1,1000}+")


def html_rows(content: bytes) -> list[dict[str, str]]:
    """Rows of the page's history table, or of its largest; no table gives no rows."""
    parser = _Tables()
    parser.read(content.decode("utf-8", "replace"))
    parser.close()
    if not parser.tables:
        return []
    # a table of the history class before all others, then the one of most rows
    table = max(parser.tables, key=lambda t: ("history" in t["class"], 0 if "history" in t["class"] else len(t["rows"])))
    rows = [_Row(section, body, cells) for section, body, cells in table["rows"]]
    head = next(filter(None, (_first(rows, rule) for rule in _HEADER_RULES)), None)
    if head is None:
        return []
    places = {i: c for i, text in enumerate(head.texts) if (c := canonical_html(text))}
    others = [r for r in rows if r is not head and r.texts]
    body = [r for r in others if r.first_body] or [r for r in others if r.section != "thead"]
    while body and body[0].has(NAME_WORDS) and body[0].has(VALUE_WORDS):  # the header again
        del body[0]
    found = ({c: r.texts[i] for i, c in places.items() if i < len(r.texts)} for r in body)
    return [r for r in found if r]


class _Row:
    def __init__(self, section: str, body: int, cells: list):
        self.section, self.first_body = section, section == "tbody" and body == 1
        self.texts = [" ".join(text) for _, text in cells]
        self.titles = any(tag == "th" for tag, _ in cells)

    def has(self, words: tuple[str, ...]) -> bool:
        line = " ".join(self.texts).lower()
        return any(w in line for w in words)


def _first(rows: list[_Row], rule) -> _Row | None:
    return next((r for r in rows if rule(r, rows)), None)


#: Which row is the header, by the first rule that any row meets.
_HEADER_RULES = (
    lambda r, rows: r.section == "thead",
    lambda r, rows: r is _first(rows, lambda x, _: x.first_body) and (r.titles or r.has(HEADER_WORDS)),
    lambda r, rows: r.section == "",
    lambda r, rows: True,
)


# ---- tables of cells


def _delimiter(text: str, looked_at: int = 50) -> str:
    """The delimiter that cuts the first lines most evenly: into the header's number of cells, the more cells the better."""
    lines = [x for x in text[:65_536].splitlines() if x.strip()][:looked_at]

    def evenness(d: str) -> tuple[float, int]:
        widths = [len(r) for r in csv.reader(lines, delimiter=d)]
        return (sum(w == widths[0] for w in widths) / len(widths) if widths and widths[0] > 1 else 0.0, widths[0] if widths else 0)

    return max(DELIMITERS, key=evenness)


def _plain(value: str) -> str:
    """A number that needs no guess at its separators, with so many decimals that none can be taken for thousands."""
    number = float(value)
    return str(int(number)) if _WHOLE(value) else f"{number:.10f}"


_WHOLE = re.compile(r"[+-]?\d+").fullmatch
#: A number, or None.
_is_number = re.compile(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?").fullmatch


def _cells_to_rows(names: list[str], cells: list[list[str]]) -> list[dict[str, str]]:
    """Rows by canonical or own (small-letter) names; a column that is numbers throughout is written plainly."""
    columns = [canonical_table(n) or n.strip().lower() for n in names]
    numeric = {i for i in range(len(columns)) if (values := [r[i] for r in cells if i < len(r) and r[i] != ""]) and all(map(_is_number, values))}
    out = []
    for r in cells:
        row = {columns[i]: _plain(v) if i in numeric else v for i, v in enumerate(r[: len(columns)]) if v != ""}
        if row:
            out.append(row)
    return out


def csv_rows(content: bytes) -> list[dict[str, str]]:
    for encoding in ("utf-8-sig", "latin-1"):
        try:
            text = content.decode(encoding)
            break
        except UnicodeDecodeError:
            continue
    lines = [r for r in csv.reader(io.StringIO(text), delimiter=_delimiter(text)) if r]
    return _cells_to_rows(lines[0], [[v.strip() for v in r] for r in lines[1:]]) if lines else []


_XML = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_ROW, _CELL, _VALUE, _TEXT = (f"{_XML}{tag}" for tag in ("row", "c", "v", "t"))


def xlsx_rows(content: bytes) -> list[dict[str, str]]:
    """Rows of the first sheet, under the headers of its first row."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        shared = ["".join(t.text or "" for t in s.iter(f"{_XML}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
        sheet = _first_sheet(z, names)
        lines: list[list[str]] = []
        for row in ElementTree.fromstring(z.read(sheet)).iter(_ROW):
            cells: list[str] = []
            for c in row.iter(_CELL):
                if c.get("r"):
                    letters = re.match(r"[A-Z]+", c.get("r"))
                    at = 0
                    for ch in letters[0] if letters else "":
                        at = at * 26 + ord(ch) - 64
                    cells += [""] * (max(0, at - 1) - len(cells))
                kind = c.get("t")
                if kind == "s":
                    cells.append(shared[int(c.find(_VALUE).text)])
                elif kind == "inlineStr":
                    texts = [t.text or "" for t in c.iter(_TEXT)]
                    cells.append(texts[0] if len(texts) == 1 else "".join(texts))
                else:
                    value = c.find(_VALUE)
                    cells.append("" if value is None else value.text or "")
            lines.append(cells)
    return _cells_to_rows(lines[0], lines[1:]) if lines else []


def _first_sheet(z: zipfile.ZipFile, names: set[str]) -> str:
    """The part that holds the workbook's first sheet; the lowest number where the workbook does not say."""
    if {"xl/workbook.xml", "xl/_rels/workbook.xml.rels"} <= names:
        targets = {r.get("Id"): r.get("Target", "") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for sheet in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_XML}sheet"):
            own = next((v for k, v in sheet.attrib.items() if k.endswith("}id")), None)
            part = targets.get(own, "").lstrip("/")
            part = part if part.startswith("xl/") else f"xl/{part}"
            if part in names:
                return part
    return min((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[-1]))


READERS = {"html": html_rows, "csv": csv_rows, "xlsx": xlsx_rows}


def read_reports(found: DataFrame, strategy: Column | None = None) -> DataFrame:
    """Bronze rows of files (path, content): canonical columns as texts, `extras`, row_idx by place in the file.

    strategy: what names a file's strategy; the file's name without its ending if not given.
    """
    named = strategy if strategy is not None else F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1)
    ready = found.select(named.alias("strategy_id"), "content", format_of(F.col("path"), F.col("content")).alias("format"))
    kind = ready.schema["strategy_id"].dataType.simpleString()

    known = frozenset(CANONICAL)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, (name, content) in enumerate(zip(b.column("format").to_pylist(), b.column("content").to_pylist())):
                rows = READERS[name](content)
                strategies = pa.array([b.column("strategy_id")[i].as_py()] * len(rows), b.column("strategy_id").type)
                columns = [pa.array([r.get(c) for r in rows], pa.string()) for c in CANONICAL]
                extras = pa.array([json.dumps(x, sort_keys=True, ensure_ascii=False) if not r.keys() <= known and (x := {k: v for k, v in r.items() if k not in known}) else None for r in rows], pa.string())
                yield pa.RecordBatch.from_arrays([strategies, pa.array(range(len(rows)), pa.int64()), *columns, extras], ["strategy_id", "row_idx", *CANONICAL, "extras"])

    return ready.mapInArrow(parse, f"strategy_id {kind}, row_idx long, {', '.join(f'{c} string' for c in CANONICAL)}, extras string")


# ---- rendering, for round trips


def as_text(bronze: DataFrame, style: str = "us") -> DataFrame:
    """Bronze columns as a report writes them: US (1,234.5) or European (1.234,5) numbers, day-first times."""
    pattern = "yyyy-MM-dd HH:mm:ss" if style == "us" else "dd.MM.yyyy HH:mm:ss"
    number = lambda c: F.format_number(c, 4) if style == "us" else F.translate(F.format_number(c, 4), ",.", ".,")
    out = {c: number(F.col(c)) for c in CANONICAL if c not in TEXT_FIELDS} | {"timestamp": F.date_format("timestamp", pattern)}
    return bronze.select("strategy_id", "row_idx", *(out.get(c, F.col(c)).alias(c) for c in CANONICAL))


def render(texts: DataFrame, kind: str, separator: str = ",") -> DataFrame:
    """(strategy_id, path, content): a report of each strategy, as CSV or HTML."""
    cells = [F.coalesce(F.col(c), F.lit("")) for c in CANONICAL]
    if kind == "csv":
        quoted = F.concat_ws(separator, *(F.when(c.contains(separator), F.concat(F.lit('"'), c, F.lit('"'))).otherwise(c) for c in cells))
        head, line, join, foot = separator.join(CANONICAL) + "\n", quoted, "\n", "\n"
    else:
        names = [HTML_HEADERS[c][0] for c in CANONICAL]
        head = '<html><body><table class="history"><thead><tr>' + "".join(f"<th>{n.replace('&', '&amp;')}</th>" for n in names) + "</tr></thead><tbody>"
        line = F.concat(F.lit("<tr>"), *(F.concat(F.lit("<td>"), c, F.lit("</td>")) for c in cells), F.lit("</tr>"))
        join, foot = "\n", "</tbody></table></body></html>"
    rows = texts.groupBy("strategy_id").agg(F.array_sort(F.collect_list(F.struct("row_idx", line.alias("line")))).alias("rows"))
    body = F.array_join(F.transform("rows", lambda r: r["line"]), join)
    return rows.select("strategy_id", F.concat(F.col("strategy_id").cast("string"), F.lit(f".{kind}")).alias("path"), F.concat(F.lit(head), body, F.lit(foot)).cast("binary").alias("content"))


def xlsx_bytes(names: list[str], rows: list[list]) -> bytes:
    """A workbook of one sheet; numbers as numbers, all else as inline texts."""

    def cell(v) -> str:
        if v is None:
            return "<c/>"
        if isinstance(v, (int, float)):
            return f"<c><v>{v!r}</v></c>"
        return f'<c t="inlineStr"><is><t>{str(v).replace("&", "&amp;").replace("<", "&lt;")}</t></is></c>'

    lines = "".join(f"<row>{''.join(map(cell, r))}</row>" for r in [names, *rows])
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{_XML[1:-1]}"><sheetData>{lines}</sheetData></worksheet>')
    return out.getvalue()


def render_xlsx(bronze: DataFrame) -> DataFrame:
    """(strategy_id, path, content): a workbook of each strategy; times as text."""
    kind = bronze.schema["strategy_id"].dataType.simpleString()
    ready = bronze.withColumn("timestamp", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss"))

    def write(key, rows):
        import pandas as pd

        rows = rows.sort_values("row_idx")
        cells = [[None if v is None or v != v else v for v in r] for r in rows[list(CANONICAL)].astype(object).itertuples(index=False)]
        return pd.DataFrame({"strategy_id": [key[0]], "path": [f"{key[0]}.xlsx"], "content": [xlsx_bytes(list(CANONICAL), cells)]})

    return ready.groupBy("strategy_id").applyInPandas(write, f"strategy_id {kind}, path string, content binary")
