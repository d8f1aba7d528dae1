"""Rule columns: every check becomes a label in an ordered ``errors`` array.

A rule is ``(label, bad)``: ``label`` text or a string column, ``bad`` a boolean column.
Null counts as "not bad", so rules state missing values explicitly.  Nothing here
shuffles; all rules of a row are one projection.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

Rule = tuple["str | Column", Column]


def labels(rules: Iterable[Rule]) -> Column:
    """Ordered array with the labels of the rules that fail."""
    return F.array_compact(
        F.array(*[F.when(bad, F.lit(label) if isinstance(label, str) else label) for label, bad in rules])
    )


def differs(actual: Column, expected: Column, skip_null: bool = False) -> Column:
    """Null-safe inequality; with ``skip_null`` a null expectation is not checked."""
    changed = ~actual.eqNullSafe(expected)
    return changed & expected.isNotNull() if skip_null else changed


def drift(pairs: Iterable[tuple[str, Column, Column]], prefix: str = "", skip_null: bool = False) -> Column:
    """Labels of the named (actual, expected) pairs that differ."""
    return labels([(prefix + label, differs(a, e, skip_null)) for label, a, e in pairs])


def when_present(rule: Column) -> Column:
    return F.coalesce(rule, F.lit(False))


def blank(text: Column) -> Column:
    return text.isNull() | (text == "")


def positive(number: Column) -> Column:
    """True for a number above zero; null is false."""
    return F.coalesce(number > 0, F.lit(False))


def finite(number: Column) -> Column:
    return F.coalesce(~F.isnan(number) & (F.abs(number) < float("inf")), F.lit(False))


def finite_bounds(number: Column, strict: bool = True) -> Column:
    """Finite and positive (``strict``) or finite and not negative."""
    low = number > 0 if strict else number >= 0
    return finite(number) & F.coalesce(low, F.lit(False))


def strict_metric(document: Column, path: str) -> Column:
    """Numeric leaf of a JSON text by path; booleans, strings and missing leaves give null.

    The JSON type is looked at first because a cast alone would turn ``true`` into 1.
    """
    leaf = F.variant_get(F.try_parse_json(document), path, "variant")
    kind = F.schema_of_variant(leaf)
    number = kind.isin("BIGINT", "INT", "SMALLINT", "TINYINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")
    return F.when(number, F.try_variant_get(F.try_parse_json(document), path, "double"))


def checksum_ok(text: Column, length: int | None = 64) -> Column:
    ok = ~blank(text)
    return ok & (F.length(text) == length) if length is not None else ok


def lowercase_sha256(text: Column) -> Column:
    return F.coalesce(text.rlike("^[0-9a-f]{64}$"), F.lit(False))


def path_contained(path: Column) -> Column:
    """Relative, non-empty path without a ``..`` part."""
    inside = ~path.startswith("/") & ~F.array_contains(F.split(path, "/"), "..")
    return ~blank(path) & F.coalesce(inside, F.lit(False))


def normal_path(path: Column) -> Column:
    """Absolute path without empty, ``.`` and ``..`` parts and without a closing slash."""
    parts = F.aggregate(
        F.split(path, "/"),
        F.array().cast("array<string>"),
        lambda done, part: F.when(part.isin("", "."), done)
        .when(part == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))))
        .otherwise(F.concat(done, F.array(part))),
    )
    return F.concat(F.lit("/"), F.array_join(parts, "/"))


def redact_path(value: Column, root: str) -> Column:
    """Absolute paths become relative to ``root`` or ``external/<name>``; other text stays."""
    base = root.rstrip("/") + "/"
    path = normal_path(value)
    return (
        F.when(~value.startswith("/"), value)
        .when(path == base[:-1], ".")
        .when(path.startswith(base), F.substr(path, F.lit(len(base) + 1)))
        .otherwise(F.concat(F.lit("external/"), F.substring_index(path, "/", -1)))
    )


def redact_command(arguments: Column, root: str) -> Column:
    return F.transform(arguments, lambda a: redact_path(a, root))


# Texts that mark exhausted device memory.
OOM_MARKERS = ("Error Code 2: OutOfMemory", "CUDA_ERROR_OUT_OF_MEMORY", "cudaErrorMemoryAllocation")


def classify_oom(text: Column) -> Column:
    """Device memory exhaustion, ignoring case; a general "out of memory" alone does not count."""
    low = F.lower(text)
    found = low.contains("cudamalloc") & low.contains("out of memory")
    for marker in OOM_MARKERS:
        found = found | low.contains(marker.lower())
    return F.coalesce(found, F.lit(False))


def tool_text_class(returncode: Column, output: Column, optional_empty: Column) -> Column:
    """``failed``, ``unavailable``, ``empty`` or ``ok`` for the text of an analysis tool."""
    low = F.lower(F.coalesce(output, F.lit("")))
    absent = low.contains("could not find any nvidia gpus") | low.contains(
        "gpu video accelerator tracing is not available"
    )
    empty = (F.trim(F.coalesce(output, F.lit("")), F.lit(" \t\r\n")) == "") | F.coalesce(output, F.lit("")).contains("SKIPPED:")
    return (
        F.when(returncode != 0, "failed")
        .when(absent, "unavailable")
        .when(empty & ~optional_empty, "empty")
        .otherwise("ok")
    )


def failure_class(errors: Column, valid: Column) -> Column:
    """``valid``; ``candidate`` when all errors name an output frame; else ``infrastructure``."""
    return (
        F.when(valid, "valid")
        .when(F.exists(errors, lambda e: ~e.startswith("output frame ")), "infrastructure")
        .otherwise("candidate")
    )


def publish_reasons(canonical: Column, acceptance_only: Column, status: Column, run_errors: Column) -> Column:
    """Ordered distinct reasons that block publishing; ``run_errors`` is array<struct<run, error>>."""
    none = F.array().cast("array<string>")
    return F.array_distinct(
        F.concat(
            canonical,
            F.when(acceptance_only, F.array(F.lit("suite is for acceptance only"))).otherwise(none),
            F.when(
                differs(status, F.lit("valid")),
                F.array(F.concat(F.lit("suite status is "), F.coalesce(status, F.lit("unknown")))),
            ).otherwise(none),
            F.transform(
                run_errors,
                lambda r: F.concat(F.lit("run "), r["run"].cast("string"), F.lit(" reproducibility: "), r["error"]),
            ),
        )
    )
