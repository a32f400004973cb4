"""Source files that do not parse (problem 4).

Each file goes through the recursive-descent parser of its language.  All
errors are kept, in order, with the first as the cause.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import parse
from ..parse.base import Lines
from ..session import spread

_SCHEMA = "file_id bigint, repo string, language string, valid boolean, n_errors int, first_line int, cause string, errors array<string>"


def checked(path: str | None, content: bytes | None) -> tuple[str, parse.Unit, str, list[tuple[int, str]]]:
    """Language, unit, text and errors (offset, message) of one file, parsed once.

    Null or empty content and unknown extensions are valid.
    """
    unit, text = parse.parse_file(path, content)
    language = parse.LANGUAGES.get(parse.extension(path), ("", None))[0]
    return language, unit, text, sorted(set(unit.errors))


def check(path: str | None, content: bytes | None) -> tuple[str, list[tuple[int, str]]]:
    """Language and errors (line, message) of one file, in order of place."""
    language, _, text, errors = checked(path, content)
    lines = Lines(text) if errors else None
    return language, [(lines.of(at), what) for at, what in errors]


def _reports(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [("file_id", pa.int64()), ("repo", pa.string()), ("language", pa.string()), ("valid", pa.bool_()), ("n_errors", pa.int32()), ("first_line", pa.int32()), ("cause", pa.string()), ("errors", pa.list_(pa.string()))]
    for b in batches:
        out: list[list] = [[] for _ in kinds]
        ids, repos, paths, contents = (b.column(n) for n in ("file_id", "repo", "display_path", "content"))
        for k in range(b.num_rows):
            language, errors = check(paths[k].as_py(), contents[k].as_py())
            row = (ids[k].as_py(), repos[k].as_py(), language, not errors, len(errors), errors[0][0] if errors else None, errors[0][1] if errors else None, [f"{n}: {w}" for n, w in errors])
            for col, v in zip(out, row):
                col.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(out, kinds)], names=[n for n, _ in kinds])


def parse_reports(files: DataFrame) -> DataFrame:
    """One row a file: ``file_id, repo, language, valid, n_errors, first_line, cause, errors``.

    ``files``: file_id, repo, display_path, content; other columns are ignored.
    Null ids and repos are kept as they are, repeated rows give repeated rows,
    an empty table gives none.  Map-only: nothing is shuffled at scale.
    """
    return spread(files.select("file_id", "repo", "display_path", "content")).mapInArrow(_reports, _SCHEMA)


def failures(files: DataFrame) -> DataFrame:
    """The ``file_id`` of files that are not valid in their language."""
    return parse_reports(files).where("not valid").select("file_id")


def failure_rates(files: DataFrame) -> DataFrame:
    """Per repo and language: ``files, failed, accepted_rate``; unknown languages under ''."""
    return parse_reports(files).groupBy("repo", "language").agg(
        F.count(F.lit(1)).alias("files"), F.count_if(~F.col("valid")).alias("failed"), F.avg(F.col("valid").cast("double")).alias("accepted_rate")
    )
