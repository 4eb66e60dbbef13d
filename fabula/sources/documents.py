"""Document scans: format detection and paragraphs from text, Word, EPUB and HTML files, as one Spark source.

Files are read with binaryFile, so partitioning and pruning by path are Spark's; containers are opened in the tasks with
the standard library. PDF needs a package that isn't installed and gives an error row. A file that can't be read gives
one row with `error` set and never stops the scan.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EXTENSIONS = {"docx": "docx", "doc": "docx", "txt": "txt", "text": "txt", "md": "md", "markdown": "md", "pdf": "pdf", "epub": "epub", "odt": "odt", "html": "html", "htm": "html"}
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
SCHEMA = "path string, format string, para_idx int, start_char int, end_char int, text string, style string, is_heading boolean, error string"


def format_of(path: Column, content: Column | None = None) -> Column:
    """By extension, else by magic bytes (PK, %PDF), else txt."""
    known = F.create_map(*[F.lit(x) for pair in EXTENSIONS.items() for x in pair])
    by_name = known[F.lower(F.regexp_extract(path, r"\.([A-Za-z]+)$", 1))]
    if content is None:
        return F.coalesce(by_name, F.lit("unknown"))
    head = F.substring(content, 1, 4)
    magic = F.when(F.hex(F.substring(content, 1, 2)) == "504B", "docx").when(F.hex(head) == "25504446", "pdf").otherwise("txt")
    return F.coalesce(by_name, magic)


class _Blocks(HTMLParser):
    BREAKS = frozenset("p div h1 h2 h3 h4 h5 h6 li tr br section article blockquote".split())
    SKIPPED = frozenset(("script", "style", "head"))

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[tuple[str, bool]] = []
        self.line, self.skip, self.heading = "", 0, False

    def flush(self) -> None:
        if text := " ".join(self.line.split()):
            self.out.append((text, self.heading))
        self.line = ""

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.skip += tag in self.SKIPPED
        if tag in self.BREAKS:
            self.flush()
            self.heading = tag[0] == "h" and tag[1:].isdigit()

    def handle_endtag(self, tag: str) -> None:
        self.skip -= tag in self.SKIPPED and self.skip > 0
        if tag in self.BREAKS:
            self.flush()
            self.heading = False

    def handle_data(self, data: str) -> None:
        if not self.skip:
            self.line += data


def html_blocks(source: str) -> list[tuple[str, str, bool]]:
    p = _Blocks()
    p.feed(source)
    p.flush()
    return [(t, "heading" if h else "", h) for t, h in p.out]


def _text(data: bytes) -> str:
    for name in ("utf-8-sig", "cp1252"):
        try:
            return data.decode(name)
        except UnicodeDecodeError:
            continue
    return data.decode("latin-1")


def plain_blocks(data: bytes, markdown: bool) -> list[tuple[str, str, bool]]:
    lines = _text(data).replace("\r\n", "\n").replace("\r", "\n").replace("\0", "").split("\n")
    out = []
    for line in lines:
        heading = bool(re.match(r"#{1,6}\s", line)) if markdown else bool(re.match(r"(?i)\s*(cap[ií]tulo|chapter|pr[oó]logo|ep[ií]logo|parte)\b", line))
        out.append((line.lstrip("#").strip() if markdown and heading else line, "heading" if heading else "", heading))
    return out


def docx_blocks(data: bytes) -> list[tuple[str, str, bool]]:
    root = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml"))
    out = []
    for p in root.iter(f"{_W}p"):
        style = p.find(f"{_W}pPr/{_W}pStyle")
        name = style.get(f"{_W}val", "") if style is not None else ""
        out.append(("".join(t.text or "" for t in p.iter(f"{_W}t")), name, name.lower().startswith(("heading", "título", "titulo", "title"))))
    return out


def docx_revisions(data: bytes) -> list[tuple[int, str, str, str]]:
    """(paragraph, kind, author, text) of tracked insertions and deletions."""
    root = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml"))
    out = []
    for i, p in enumerate(root.iter(f"{_W}p")):
        for kind, tag, text in (("insertion", "ins", "t"), ("deletion", "del", "delText")):
            out += [(i, kind, e.get(f"{_W}author", ""), "".join(t.text or "" for t in e.iter(f"{_W}{text}"))) for e in p.iter(f"{_W}{tag}")]
    return out


def epub_blocks(data: bytes) -> list[tuple[str, str, bool]]:
    z = zipfile.ZipFile(io.BytesIO(data))
    opf = re.search(r'full-path="([^"]+)"', z.read("META-INF/container.xml").decode())[1]
    root, base = ElementTree.fromstring(z.read(opf)), opf.rpartition("/")[0]
    local = lambda e: e.tag.rpartition("}")[2]
    items = {e.get("id"): e.get("href") for e in root.iter() if local(e) == "item"}
    out = []
    for ref in (e for e in root.iter() if local(e) == "itemref"):
        if href := items.get(ref.get("idref")):
            out += html_blocks(_text(z.read(f"{base}/{href}" if base else href)))
    return out


def _blocks(kind: str, data: bytes) -> list[tuple[str, str, bool]]:
    if kind in ("txt", "md"):
        return plain_blocks(data, kind == "md")
    if kind in ("docx", "epub"):
        return {"docx": docx_blocks, "epub": epub_blocks}[kind](data)
    if kind == "html":
        return html_blocks(_text(data))
    raise ValueError(f"unsupported format: {kind}")


def _parse(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    types = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.bool_(), pa.string()]
    for b in it:
        out = []
        for path, kind, data in zip(b.column("path").to_pylist(), b.column("format").to_pylist(), b.column("content").to_pylist(), strict=True):
            try:
                at = 0
                for i, (text, style, heading) in enumerate(_blocks(kind, data)):
                    out.append((path, kind, i, at, at + len(text), text, style, heading, None))
                    at += len(text) + 1
            except Exception as e:  # a broken file is a row, not a failed job
                out.append((path, kind, 0, 0, 0, "", "", False, f"{type(e).__name__}: {e}"))
        columns = list(zip(*out, strict=True)) or [()] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)


def read_documents(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Paragraphs of all files under path: offsets run over one axis per file, with one separator between paragraphs."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return files.select("path", format_of(F.col("path"), F.col("content")).alias("format"), "content").mapInArrow(_parse, SCHEMA)


def write_alerts_json(alerts: DataFrame, path: str) -> None:
    alerts.write.mode("overwrite").json(path)


def export_project(tables: dict[str, DataFrame], project_id: int, path: str) -> None:
    """One project's rows of each table, a Parquet folder for each; tables without project_id are kept whole."""
    for name, df in tables.items():
        rows = df.filter(F.col("project_id") == project_id) if "project_id" in df.columns else df
        rows.write.mode("overwrite").parquet(f"{path}/{name}")


def import_project(spark: SparkSession, path: str, names: list[str], project_id: int) -> dict[str, DataFrame]:
    """Exported tables under a new project id."""
    out = {}
    for name in names:
        df = spark.read.parquet(f"{path}/{name}")
        out[name] = df.withColumn("project_id", F.lit(project_id).cast(dict(df.dtypes)["project_id"])) if "project_id" in df.columns else df
    return out
