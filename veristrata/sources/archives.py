"""Zip archives and MediaWiki dumps (S-08, S-09, N-37, N-38): a file is read by one task, member by member, page by page."""

from __future__ import annotations

import bz2
import io
import re
import zipfile
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

PAGE_ROWS = 500


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def read_zip(spark: SparkSession, path: str, pattern: str = r".*") -> DataFrame:
    """(archive, member, at, content) of the members whose names match; `at` is the number in the name, else null."""

    def run(batches):
        for b in batches:
            for name, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist()):
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    for member in archive.namelist():
                        if not member.endswith("/") and re.fullmatch(pattern, member):
                            number = re.search(r"(\d+)\.[a-z]+$", member)
                            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([member]), pa.array([int(number[1]) if number else None], pa.int64()), pa.array([archive.read(member)], pa.binary())], ["archive", "member", "at", "content"])

    return _files(spark, path).mapInArrow(run, "archive string, member string, at bigint, content binary")


def pages_of(stream):
    """(id, title, namespace, redirect, wikitext) of a dump's pages; what is read is let go page by page."""
    root, local = None, lambda tag: tag.rsplit("}", 1)[-1]
    for event, element in ElementTree.iterparse(stream, events=("start", "end")):
        root = element if root is None else root
        if event == "end" and local(element.tag) == "page":
            found = {local(x.tag): x.text or "" for x in element.iter() if local(x.tag) in ("title", "ns", "text")}
            number = next((x.text for x in element if local(x.tag) == "id"), "")
            yield number, found.get("title", ""), int(found.get("ns") or 0), any(local(x.tag) == "redirect" for x in element), found.get("text", "")
            root.clear()


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Pages of XML dumps, plain or .bz2, and their leads as prose."""
    names = ["page_id", "title", "namespace", "redirect", "wikitext", "lead"]

    def run(batches):
        for b in batches:
            for name, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist()):
                stream, held = io.BytesIO(content), []
                for page in pages_of(bz2.open(stream) if name.endswith(".bz2") else stream):
                    held.append((*page, lead(page[4])))
                    if len(held) == PAGE_ROWS:
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*held)], names)
                        held = []
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*held)], names)

    return _files(spark, path).mapInArrow(run, "page_id string, title string, namespace bigint, redirect boolean, wikitext string, lead string")


def prose(wikitext: str) -> str:
    """Wikitext without comments, references, templates, tables, links' marks and tags."""
    t = re.sub(r"<!--.*?-->|<ref[^>/]*/>|<ref.*?</ref>|<(math|gallery|timeline)\b.*?</\1>", " ", wikitext, flags=re.S | re.I)
    for _ in range(50):
        t, n = re.subn(r"\{\{[^{}]*\}\}", " ", t)
        if not n:
            break
    t = re.sub(r"\{\|.*?\|\}", " ", t, flags=re.S)
    t = re.sub(r"\[\[[^\[\]|]*:[^\[\]]*\]\]", " ", t)
    t = re.sub(r"\[\[(?:[^\[\]|]*\|)?([^\[\]|]*)\]\]", r"\1", t)
    t = re.sub(r"\[\S+ ([^\]]*)\]", r"\1", t)
    t = re.sub(r"<[^>]+>|'{2,}", "", t).replace("&nbsp;", " ").replace("&amp;", "&")
    lines = [x.strip() for x in t.split("\n") if x.strip() and x.strip()[0] not in "*#|!{}=:;"]
    t = re.sub(r"\(\s*[,;]?\s*\)", "", " ".join(lines))
    return re.sub(r"\s+", " ", re.sub(r"\s+([,.;:।])", r"\1", t)).strip()


def capped(text: str, most: int = 1200) -> str:
    """At most `most` characters, cut behind the last sentence that ends in the second half, else at white space."""
    if len(text) <= most:
        return text
    ends = [m.end() for m in re.finditer(r"[.!?।](?=\s|$)", text[:most])]
    if ends and ends[-1] >= most // 2:
        return text[: ends[-1]].strip()
    space = text.rfind(" ", 0, most)
    return text[:space].strip() if space > 0 else text[:most]


def lead(wikitext: str, most: int = 1200, least: int = 60) -> str:
    """A page's text before its first heading, as prose; empty if too short."""
    text = capped(prose(re.split(r"^=+[^=]", wikitext, maxsplit=1, flags=re.M)[0]), most)
    return text if len(text) >= least else ""
