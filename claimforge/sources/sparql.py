"""Building a slice from SPARQL: query texts, cached answers, and the way from result rows to triple rows.

No connection is opened here: a caller passes the function that fetches (see `store.fetch_with_retry`).
"""

from __future__ import annotations

import json
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.snapshot import bare_id, first_sighting_nodes, in_band, ranked_edges, value_type
from .store import cache_key

WD, WDT = "http://www.wikidata.org/entity/", "http://www.wikidata.org/prop/direct/"


def enumeration_query(kind: str = "Q571", low: int = 5, high: int = 40, limit: int | None = 200) -> str:
    """Items of a class whose number of site links lies in a band: the first ``limit``, or all if that is None."""
    return (
        "SELECT ?item ?sitelinks WHERE {\n"
        f"  ?item wdt:P31 wd:{kind} ;\n        wikibase:sitelinks ?sitelinks .\n"
        f"  FILTER(?sitelinks >= {low} && ?sitelinks <= {high})\n"
        "}\nORDER BY ?item" + ("" if limit is None else f"\nLIMIT {limit}")
    )


def triples_query(ids: list[str]) -> str:
    """All outgoing direct statements of items that have an English label and a count of site links; other labels, the
    description and the property's type may lack. Without items a query that has no rows."""
    if not ids:
        return "SELECT ?item ?prop ?value WHERE { FILTER(false) }"
    values = " ".join(f"wd:{i}" for i in sorted(ids))
    english = lambda v, name: f'  OPTIONAL {{ {v} {name} . FILTER(LANG({name.split()[-1]}) = "en") }}\n'
    return (
        "SELECT ?item ?itemLabel ?itemDescription ?sitelinks ?prop ?propLabel ?value ?valueLabel ?pt WHERE {\n"
        f"  VALUES ?item {{ {values} }}\n  ?item ?direct ?value .\n"
        "  ?prop wikibase:directClaim ?direct .\n"
        f'  FILTER(STRSTARTS(STR(?direct), "{WDT}"))\n  ?item wikibase:sitelinks ?sitelinks ; rdfs:label ?itemLabel .\n  FILTER(LANG(?itemLabel) = "en")\n'
        "  OPTIONAL { ?prop wikibase:propertyType ?pt }\n"
        + english("?item", "schema:description ?itemDescription")
        + english("?prop", "rdfs:label ?propLabel")
        + english("?value", "rdfs:label ?valueLabel")
        + "}\nORDER BY ?item ?prop ?value"
    )


def cached(fetch: Callable[[str], str], folder: str, endpoint: str, query: str) -> str:
    """The path of the JSON answer of a query, fetched only if the folder doesn't hold it yet."""
    path = Path(folder) / f"{cache_key(endpoint, query)}.json"
    if not path.exists():
        answer = fetch(query)
        json.loads(answer)  # only answers that can be read are kept
        path.parent.mkdir(parents=True, exist_ok=True)
        part = path.with_suffix(".part")
        part.write_text(answer)
        part.rename(path)
    return str(path)


def _cell(name: str) -> Column:
    """A variable of a result row; absent and empty are null."""
    return F.nullif(F.try_element_at("row", F.lit(name)), F.lit(""))


def enumerated(rows: DataFrame, low: int = 5, high: int = 40) -> DataFrame:
    """id and sitelinks of result rows (row: map) whose count is a number in the band."""
    out = rows.select(bare_id(_cell("item")).alias("id"), F.expr("try_cast(trim(row['sitelinks']) AS INT)").alias("sitelinks"))
    return out.where(F.col("id").isNotNull() & in_band(F.col("sitelinks"), low, high))


def triple_rows(rows: DataFrame, selected: DataFrame) -> DataFrame:
    """Triple rows of result rows (row, pos) about selected ids; kinds of values that aren't kept drop out."""
    kind = value_type(_cell("pt"))
    item = kind == "item"
    subject, prop = bare_id(_cell("item")), bare_id(_cell("prop"))
    value, label = _cell("value"), _cell("valueLabel")
    out = rows.select(
        F.col("pos").cast("long").alias("row_ord"), subject.alias("subject_id"), F.coalesce(_cell("itemLabel"), subject).alias("subject_label"),
        _cell("itemDescription").alias("subject_description"), F.expr("try_cast(row['sitelinks'] AS INT)").alias("subject_sitelinks"),
        prop.alias("property_id"), F.coalesce(_cell("propLabel"), prop).alias("property_label"),
        F.when(item, bare_id(value)).alias("object_id"),
        F.coalesce(label, F.when(item, bare_id(value)).otherwise(value), F.lit("")).alias("object_label"), kind.alias("value_type"),
    )
    kept = out.where("subject_id IS NOT NULL AND property_id IS NOT NULL AND value_type IS NOT NULL")
    return kept.join(selected.select(F.col("id").alias("subject_id")).distinct(), "subject_id", "left_semi")


def build_slice(enumeration: DataFrame, fetched: DataFrame, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """nodes and edges from the rows of both queries: the first ``limit`` ids in order, counted before duplicates go."""
    chosen = enumerated(enumeration).orderBy("id")
    rows = triple_rows(fetched, chosen if limit is None else chosen.limit(limit))
    return first_sighting_nodes(rows), ranked_edges(rows.withColumnRenamed("row_ord", "edge_ord"))
