"""Tables of a page in one pass over its marks, each cell with where it begins and ends in the source."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

#: Comments and hidden elements as a whole, and tags; what is in quotes ends no tag.
_MARK = re.compile(r"""<(?:!--.*?(?:-->|\Z)|(script|style|template|noscript)\b.*?(?:</\1\s*>|\Z)|(/?)([a-z][a-z0-9]*+)(?:>|((?:[^>"']++|"[^"]*"|'[^']*'|["'])*+)>))""", re.DOTALL | re.IGNORECASE)
_SPAN = re.compile(r"""(?:^|\s)(rowspan|colspan)\s*=\s*["']?\s*([0-9]+)""", re.IGNORECASE)
_APART = frozenset(("br", "p", "div", "li"))


@dataclass(slots=True)
class Cell:
    begin: int
    header: bool
    rowspan: int = 1
    colspan: int = 1
    end: int = -1
    parts: list[str] = field(default_factory=list)

    @property
    def text(self) -> str:
        own = "".join(self.parts)
        return " ".join((html.unescape(own) if "&" in own else own).split())


@dataclass
class Table:
    begin: int
    end: int = -1
    rows: list[list[Cell]] = field(default_factory=list)
    fault: str | None = None


def tables(page: str, most_rows: int, most_columns: int) -> list[Table]:
    """The outermost tables.  A cell ends with its end tag, or where the next cell or row or the table's end begins.

    A table has a fault if another one is in it, if a span is beyond the limits, or if it is not closed; a span
    that is no positive number is 1.  Text of comments and hidden elements is none."""
    out: list[Table] = []
    table: Table | None = None
    cell: Cell | None = None
    depth = at = 0

    for m in _MARK.finditer(page):
        _, closing, tag, attributes = m.groups()
        begin, end = m.span()
        if cell is not None and depth == 1:
            cell.parts.append(page[at:begin])
        at = end
        if tag is None:
            continue
        tag = tag.lower()
        if tag == "table":
            if not closing:
                depth += 1
                if table is None:
                    table = Table(begin)
                    out.append(table)
                else:
                    table.fault = "nested table"
            elif table is not None:
                depth -= 1
                if not depth:
                    if cell is not None:
                        cell.end, cell = begin, None
                    table.end, table = end, None
        elif depth != 1:
            continue
        elif tag == "td" or tag == "th":
            if cell is not None:
                cell.end, cell = end if closing else begin, None
            if not closing:
                cell = Cell(begin, tag == "th")
                if attributes:
                    spans = {k.lower(): max(int(v), 1) for k, v in _SPAN.findall(attributes)}
                    cell.rowspan, cell.colspan = spans.get("rowspan", 1), spans.get("colspan", 1)
                    if cell.rowspan > most_rows or cell.colspan > most_columns:
                        table.fault = table.fault or "span beyond limit"
                if not table.rows:
                    table.rows.append([])
                table.rows[-1].append(cell)
        elif tag == "tr":
            if cell is not None:
                cell.end, cell = begin, None
            if not closing:
                table.rows.append([])
        elif tag in _APART and cell is not None:
            cell.parts.append(" ")
    if table is not None:
        if cell is not None and depth == 1:
            cell.parts.append(page[at:])
        if cell is not None:
            cell.end = len(page)
        table.end, table.fault = len(page), table.fault or "table not closed"
    return out


def columns(rows: list[list[Cell]]) -> list[list[int]]:
    """The column where each cell stands once spans are laid out.  Of a column only the row is kept up to which it is taken."""
    taken: list[int] = []
    out = []
    for r, row in enumerate(rows):
        places, c = [], 0
        for cell in row:
            while c < len(taken) and taken[c] > r:
                c += 1
            places.append(c)
            taken += [0] * (c + cell.colspan - len(taken))
            below = min(r + cell.rowspan, len(rows))
            taken[c : c + cell.colspan] = [max(t, below) for t in taken[c : c + cell.colspan]]
            c += cell.colspan
        out.append(places)
    return out


def labelled(rows: list[list[str]]) -> list[str]:
    """Rows as lines: the first with bars; others of its width as 'first — header: value; ...', the rest with bars."""
    bars = [[c or "-" for c in row] for row in rows]
    if not bars:
        return []
    head = bars[0]
    line = lambda own: f"{own[0]} — " + "; ".join(f"{h}: {c}" for h, c in zip(head[1:], own[1:])) if len(own) == len(head) > 1 else " | ".join(own)
    return [" | ".join(head), *map(line, bars[1:])]


def with_lines(page: str, most_rows: int = 2000, most_columns: int = 64) -> str:
    """A page whose tables are blocks of lines in their places."""
    out, at = [], 0
    for t in tables(page, most_rows, most_columns):
        lines = labelled([[c.text for c in row] for row in t.rows if row])
        out += [page[at : t.begin], "<div>", html.escape("\0".join(lines)).replace("\0", "<br>") if "\0" not in page else "<br>".join(map(html.escape, lines)), "</div>"]
        at = t.end
    return "".join(out) + page[at:]
