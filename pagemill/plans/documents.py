"""From fetched pages to the document table, and the link-expansion job."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.config import CrawlConfig
from pagemill.functions.memo import kept_columns
from pagemill.functions.urls import normalize_url, url_domain
from pagemill.operators.bucketed import BucketedTable
from pagemill.operators.enrich import assemble_documents
from pagemill.operators.extract import extract_fields, link_lists, page_links
from pagemill.operators.frontier import Expansion, walk, walk_buckets
from pagemill.operators.language import detect_language
from pagemill.operators.sizing import checkpoint_folder, cut_lineage
from pagemill.operators.upsert import last_by_key
from pagemill.plans.extractors import get_extractor
from pagemill.sources.collection import load_documents, upsert_documents
from pagemill.sources.fetches import judge_fetches


@kept_columns
def _canonical() -> Column:
    return normalize_url(F.col("url"))


def parse_pages(
    pages: DataFrame,
    extractor: str = "heuristic",
    seed_domain: str | None = None,
    link_scope: str | None = None,
    key: str = "page_id",
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Pages ``(key, url, html, fetched_at)`` to parsed rows with their links; ``keep`` passes further columns on.

    The heuristic extractor finds links where it cuts the text: one exchange of the
    pages gives all. For others links are exchanged on their own, without the pages.
    """
    chosen = get_extractor(extractor)
    scope = link_scope or chosen.link_scope
    if chosen.fields is extract_fields:
        parsed = extract_fields(pages, key, ("url", "fetched_at", *keep), links=scope, seed_domain=seed_domain)
        return parsed.withColumn("url", _canonical()).where(F.col("url").isNotNull())
    links = link_lists(page_links(pages, key, scope, seed_domain), key)
    heads = pages.select(key, _canonical().alias("url"), "fetched_at", *keep)
    return (
        chosen.fields(pages, key)
        .join(heads.where(F.col("url").isNotNull()), key)
        .join(links, key, "left")
    )


def build_documents(
    pages: DataFrame,
    profile: DataFrame | None = None,
    extractor: str = "heuristic",
    seed_domain: str | None = None,
    link_scope: str | None = None,
    key: str = "page_id",
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Pages to documents, one per page with text; ``keep`` passes columns of the pages on.

    The parsed rows are written once (checkpoint folder) because the language
    step reads them a second time.
    """
    parsed = parse_pages(pages, extractor, seed_domain, link_scope, key, tuple(name for name in keep if name != key))
    if profile is None:
        return assemble_documents(parsed, None, key, keep)
    parsed = cut_lineage(parsed)
    return assemble_documents(parsed, detect_language(parsed, profile, key), key, keep)


_HEADS = {"url": "string", "page_id": "bigint", "success": "boolean"}


def run_expansion(
    config: CrawlConfig,
    fetches: DataFrame,
    profile: DataFrame | None = None,
    link_scope: str | None = None,
) -> tuple[Expansion, DataFrame]:
    """Walk from the start URL over a fetch log and merge into the collection.

    ``fetches`` needs ``page_id, url, final_url, status_code, content_type,
    content_length, html, error, fetched_at``; ``page_id`` identifies a fetch. Of several
    fetches of one URL the latest successful one counts, or the latest failure. Each
    level of the walk reads the log for the pages that it reaches and parses those only;
    what was parsed is kept per level until the documents are made. Returns the walk and
    the merged collection, as saved to ``config.output_path``.
    """
    spark = fetches.sparkSession
    config.check_on(spark)
    stored = cut_lineage(load_documents(spark, config.output_path).select("url", "source"))
    seed_domain = spark.range(1).select(url_domain(normalize_url(F.lit(config.start_url)))).first()[0]
    folder = f"{checkpoint_folder(spark)}/expansion-{uuid.uuid4().hex}"

    # One fetch per canonical URL: the latest that succeeded, the latest of all where none did.
    site = judge_fetches(fetches.where(url_domain(F.col("url")) == seed_domain))
    latest = site.groupBy(_canonical().alias("url")).agg(F.max(F.struct("success", "fetched_at", "page_id")).alias("at"))
    heads = BucketedTable.open(spark, f"{folder}/heads", _HEADS, "url", walk_buckets(site))
    heads.append(latest.select("url", F.col("at.page_id").cast("bigint").alias("page_id"), "at.success"))
    log = fetches.select("page_id", F.col("final_url").alias("url"), "html", "fetched_at")
    schema: list[T.StructType] = []

    def visit(level: DataFrame, depth: int) -> DataFrame:
        level = cut_lineage(level.join(heads.read(), "url", "left"))
        reached = level.where("success").select("page_id", F.col("url").alias("requested"))
        parsed = parse_pages(log.join(reached, "page_id"), config.extractor, seed_domain, link_scope, keep=("requested",)).drop("meta")
        schema[:] = [parsed.schema]
        parsed.write.parquet(f"{folder}/parsed/level={depth}")
        links = F.transform(F.coalesce("links_internal", F.array().cast("array<string>")), lambda link, i: F.struct(i.cast("bigint").alias("rank"), link.alias("link")))
        found = spark.read.schema(parsed.schema).parquet(f"{folder}/parsed/level={depth}").select(F.col("requested").alias("url"), links.alias("links"))
        outcome = F.when(F.col("links").isNotNull(), "saved").when(F.col("success"), "empty").otherwise("failed")
        return level.join(found, "url", "left").withColumn("outcome", outcome)

    try:
        walked = walk(
            spark, config.start_url, visit, config.max_depth, config.max_pages, None if not config.resume else stored.select("url"),
            stored.where(F.col("source") == seed_domain).count(), config.allowed_path_prefix, config.allowed_path_regex,
        )
    finally:
        heads.drop()
    if schema:
        parsed = spark.read.schema(schema[0]).parquet(f"{folder}/parsed").drop("level")
        saved = walked.tasks.where(F.col("outcome") == "saved").select(F.col("url").alias("requested"), F.struct("depth", "rank").alias("at"))
        # Two pages may redirect to one document; the later in the walk stands.
        rows = cut_lineage(last_by_key(parsed.join(saved, "requested").drop("requested"), "url", "at").drop("at"))
        languages = None if profile is None else detect_language(rows, profile, "page_id")
        upsert_documents(assemble_documents(rows, languages), config.output_path)
    return walked, load_documents(spark, config.output_path)
