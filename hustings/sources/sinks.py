"""Writers: tables in parallel, small exports as single files from the driver."""

from __future__ import annotations

import json
from pathlib import Path
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import Column, DataFrame

#: Rows that a single-file export may have.
MOST_ROWS = 1_000_000


def csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("header", True).option("escape", '"').csv(path)


def parquet(df: DataFrame, path: str, by: tuple[str, ...] = (), mode: str = "errorifexists") -> None:
    writer = df.write.mode(mode)
    (writer.partitionBy(*by) if by else writer).parquet(path)


def rows(df: DataFrame) -> list[dict]:
    """All rows of a small table; ValueError when it isn't one."""
    got = [r.asDict(recursive=True) for r in df.limit(MOST_ROWS + 1).toLocalIterator()]
    if len(got) > MOST_ROWS:
        raise ValueError(f"more than {MOST_ROWS} rows")
    return got


def csv_file(df: DataFrame, path: str, *order: Column | str) -> None:
    """One CSV file with a byte order mark, sorted if an order is given."""
    import csv as lib

    with open(path, "w", encoding="utf-8-sig", newline="") as f:
        out = lib.writer(f)
        out.writerow(df.columns)
        for r in rows(df.orderBy(*order) if order else df):
            out.writerow(["" if v is None else v for v in r.values()])


def json_file(df: DataFrame, path: str) -> None:
    """A list of objects, or one object for a single row."""
    got = rows(df)
    Path(path).write_text(json.dumps(got[0] if len(got) == 1 else got, ensure_ascii=False, indent=2, default=str), encoding="utf-8")


def swap(df: DataFrame, path: str) -> None:
    """Replaces a local table by a new one written beside it; the old one stays as .bak until the next time."""
    import shutil

    old, new, bak = Path(path), Path(f"{path}.new"), Path(f"{path}.bak")
    df.write.mode("overwrite").parquet(str(new))
    if bak.exists():
        shutil.rmtree(bak)
    if old.exists():
        old.rename(bak)
    new.rename(old)


def gexf(nodes: DataFrame, edges: DataFrame, path: str, colour: str | None = None) -> None:
    """A GEXF 1.2 graph: nodes need id and label, edges src, dst and weight; other columns become typed attributes."""
    kinds = {"int": "integer", "bigint": "long", "double": "double", "float": "float", "boolean": "boolean"}
    out = ['<?xml version="1.0" encoding="UTF-8"?>', '<gexf xmlns="http://www.gexf.net/1.2draft" xmlns:viz="http://www.gexf.net/1.2draft/viz" version="1.2">', '<graph mode="static" defaultedgetype="undirected">']
    extra = {}
    for name, df, own in (("node", nodes, ("id", "label", colour)), ("edge", edges, ("src", "dst", "weight"))):
        extra[name] = [(c, kinds.get(t, "string")) for c, t in df.dtypes if c not in own]
        out.append(f'<attributes class="{name}">' + "".join(f"<attribute id={quoteattr(str(k))} title={quoteattr(c)} type={quoteattr(t)}/>" for k, (c, t) in enumerate(extra[name])) + "</attributes>")

    def values(name: str, r: dict) -> str:
        return "<attvalues>" + "".join(f'<attvalue for="{k}" value={quoteattr(str(r[c]))}/>' for k, (c, _) in enumerate(extra[name]) if r[c] is not None) + "</attvalues>"

    out.append("<nodes>")
    for r in rows(nodes):
        paint = ""
        if colour and r[colour]:
            red, green, blue = (int(r[colour].lstrip("#")[i : i + 2], 16) for i in (0, 2, 4))
            paint = f'<viz:color r="{red}" g="{green}" b="{blue}"/>'
        out.append(f"<node id={quoteattr(str(r['id']))} label={quoteattr(str(r['label']))}>{values('node', r)}{paint}</node>")
    out.append("</nodes><edges>")
    for k, r in enumerate(rows(edges)):
        out.append(f'<edge id="{k}" source={quoteattr(str(r["src"]))} target={quoteattr(str(r["dst"]))} weight="{r["weight"] if r["weight"] is not None else 0.0}">{values("edge", r)}</edge>')
    out.append("</edges></graph></gexf>")
    Path(path).write_text("\n".join(out), encoding="utf-8")


def svg_timeline(points: DataFrame, path: str, x: str, y: str, size: str, label: str, width: int = 1200, row: int = 28) -> None:
    """Points by an ordered x and a row for each y, as a self-contained SVG file."""
    got = rows(points.orderBy(x, y))
    xs, ys = (list(dict.fromkeys(sorted(str(r[c]) for r in got))) for c in (x, y))
    most = max((float(r[size] or 0) for r in got), default=1.0) or 1.0
    at_x = {v: 160 + k * (width - 200) / max(len(xs) - 1, 1) for k, v in enumerate(xs)}
    out = [f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{row * (len(ys) + 2)}" font-size="11">']
    out += [f'<text x="8" y="{row * (k + 1) + 4}">{escape(v)}</text>' for k, v in enumerate(ys)]
    out += [f'<text x="{at_x[v]:.0f}" y="{row * (len(ys) + 1)}" text-anchor="middle">{escape(v)}</text>' for v in xs]
    for r in got:
        radius = 2 + (row / 2 - 3) * (float(r[size] or 0) / most) ** 0.5
        out.append(f'<circle cx="{at_x[str(r[x])]:.1f}" cy="{row * (ys.index(str(r[y])) + 1)}" r="{radius:.1f}" fill="#4477aa" fill-opacity="0.7"><title>{escape(str(r[label]))}</title></circle>')
    Path(path).write_text("\n".join([*out, "</svg>"]), encoding="utf-8")
