"""Record identities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import title_key


def _present(value: Column) -> Column:
    return F.nullif(value, F.lit(""))


def identity_hints(doi: Column, pmid: Column, pmcid: Column, title: Column, *extra: Column) -> Column:
    """Every key the record can be recognised by."""
    return F.array_distinct(
        F.array_compact(
            F.array(
                *extra,
                F.concat(F.lit("doi:"), F.lower(_present(doi))),
                F.concat(F.lit("pmid:"), _present(pmid)),
                F.concat(F.lit("pmcid:"), _present(pmcid)),
                title_key(title),
            )
        )
    )


def dedupe_key(doi: Column, pmid: Column, pmcid: Column, title: Column) -> Column:
    """The strongest identity; precedence doi, pmid, pmcid, title."""
    return F.coalesce(
        F.concat(F.lit("doi:"), F.lower(_present(doi))),
        F.concat(F.lit("pmid:"), _present(pmid)),
        F.concat(F.lit("pmcid:"), _present(pmcid)),
        title_key(title),
    )


def fingerprint(*columns: Column) -> Column:
    return F.sha2(F.to_json(F.struct(*columns)), 256)
