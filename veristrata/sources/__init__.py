"""Readers and writers: JSON lines, CSV with literals, zip archives, MediaWiki dumps, HTML pages, vectors."""

from veristrata.sources.archives import read_pages, read_zip  # noqa: F401
from veristrata.sources.html import leads, parsed_pages  # noqa: F401
from veristrata.sources.tables import count_lines, read_csv, read_jsonl, read_vectors, scalar, splits_of, write_jsonl  # noqa: F401
