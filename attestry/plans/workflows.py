"""The daily brief, research and replay, put together from the operators."""

from __future__ import annotations

from collections import UserDict
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import tokenize
from ..operators import claims, corroborate, governance, index, registry, retrieve, snapshots, stories, verify
from ..sources.config import Profile
from ..storage import written


@dataclass(frozen=True)
class Seams:
    """The stages that a model may take over. Each default is the engine's own, which needs none.

    extract: evidence rows to claims; match: claims to (id, root), None for token likeness; embed: (id, text) to
    (id, vector); synthesize: claims and evidence to bodies; verify: bodies and evidence to checks; plan: a question
    to its parts; reflect: parts that nothing covers (text) to another try each (text, again); discover: urls to
    links (ord, url, title) for candidate sources, None for no discovery.
    """

    extract: Callable[[DataFrame], DataFrame] = claims.extract
    match: Callable[[DataFrame], DataFrame] | None = None
    embed: Callable[[DataFrame], DataFrame] = index.embedded
    synthesize: Callable[[DataFrame, DataFrame], DataFrame] = verify.brief_bodies
    verify: Callable[[DataFrame, DataFrame], DataFrame] = verify.check_bodies
    plan: Callable[[str], list[str]] | None = None
    reflect: Callable[[DataFrame], DataFrame] | None = None
    discover: Callable[[DataFrame], DataFrame] | None = None
    names: tuple[tuple[str, str], ...] = (("embedder", "hashing-256"), ("synthesizer", "extractive"), ("verifier", "overlap"))

    @property
    def models(self) -> dict[str, str]:
        """The names of the models, for manifests."""
        return dict(self.names)


def evidence_claims(evidence: DataFrame, sources: DataFrame, include_tags: list[str], extract: Callable[[DataFrame], DataFrame] = claims.extract) -> DataFrame:
    """The claims of evidence (sid, source_id, cluster_id, text, published_at, entity_ids), numbered in order."""
    own = registry.with_source(evidence, sources, include_tags).withColumn("n", F.substring("sid", 2, 20).cast("long"))
    found = extract(own.select("n", "sid", "source_id", "cluster_id", "independence_group", "tier", "entity_ids", "published_at", "text"))
    return found.withColumn("id", claims.claim_id(F.col("n"), F.col("line"), F.col("pos"))).drop("n", "line", "pos")


class Results(UserDict):
    """Tables by name. One that is given as a function of the results is made when it is first asked for, once."""

    def __getitem__(self, name: str) -> DataFrame:
        held = self.data[name]
        if not isinstance(held, DataFrame):
            self.data[name] = held = held(self)
        return held


def tail(evidence: DataFrame, sources: DataFrame, profile: Profile, seams: Seams = Seams()) -> Results:
    """Claims, verdicts, body, checks and the shipped body of evidence: what briefs, research and replays share.

    A body is one row, so it takes the memory of one task: it is put together, and stored, only for those who ask for it, its checks or
    what is shipped. Claims and verdicts are tables of any size.
    """
    c = written(evidence_claims(evidence, sources, profile.include_tags, seams.extract), "claims")
    shared = ["text", "claim_type", "verdict", "independent_voices", "tier1_voices", "sids", "sources", "story_cluster", "conflict", "dropped"]
    told = c.filter("claim_type = 'event'")
    events = corroborate.corroborate_events(told, profile.event, seams.match(told) if seams.match else None).select("claim_group", *shared)
    # quantities follow the events, in order of their first claim
    q = c.filter("claim_type = 'quantitative'")
    first = q.groupBy(*[F.coalesce(k, F.lit(v)).alias(k) for k, v in (("entity_id", "?"), ("metric", "?"), ("as_of", ""))]).agg(F.min("id").alias("first"))
    quants = corroborate.corroborate_quantities(q, profile.quantitative, profile.relative, profile.absolute).join(first, ["entity_id", "metric", "as_of"])
    done = written(events.unionByName(quants.select((F.col("first") + (1 << 60)).alias("claim_group"), *shared)), "corroborated")
    seen = evidence.withColumn("body_id", F.lit(1))

    def body(_: Results) -> DataFrame:
        return written(verify.validate_citations(seams.synthesize(done.withColumn("body_id", F.lit(1)), seen), seen).select("body_id", F.col("cleaned").alias("body")), "body")

    return Results({
        "claims": c, "verdicts": done, "body": body, "checks": lambda r: seams.verify(r["body"], seen),
        "shipped": lambda r: verify.drop_unsupported(r["body"], r["checks"]), "precision": lambda r: verify.precision(r["checks"]),
    })


def daily_brief(chunks: DataFrame, sources: DataFrame, profile: Profile, now: datetime, seams: Seams = Seams()) -> Results:
    """The brief of the last hours: scoped window, stories, then the tail. chunks: chunk_id, content_hash, source_id,
    cluster_id, title, text, published_at, entity_ids."""
    window = snapshots.window_scan(registry.scoped(chunks, sources, profile.include_tags, profile.min_tier), now, profile.window_hours)
    evidence = written(stories.build_stories(window), "evidence").withColumn("title", F.col("headline"))
    return {"evidence": evidence} | tail(evidence.withColumn("cluster_id", F.col("story")), sources, profile, seams)


def plan(question: str, most: int = 4) -> list[str]:
    """A question's parts around " and ", or the question."""
    parts = [p.strip(" ?.") for p in question.split(" and ") if p.strip(" ?.")]
    return (parts if len(parts) > 1 else [question.strip()])[:most]


def search(queries: DataFrame, chunks: DataFrame, k: int = 24, embed: Callable[[DataFrame], DataFrame] = index.embedded) -> DataFrame:
    """Hybrid hits (query_id, id, score, rank) of queries (query_id, text, expanded) over scoped chunks (id, text)."""
    post = written(index.postings(chunks), "postings")
    asked = queries.select(F.col("query_id").alias("id"), F.col("expanded").alias("text"))
    lexical = retrieve.sparse_topk(index.postings(asked).withColumnRenamed("id", "query_id"), post, chunks.count(), 4 * k)
    near = retrieve.dense_topk(embed(queries.select(F.col("query_id").alias("id"), "text")).withColumnRenamed("id", "query_id"), written(embed(chunks), "vectors"), 4 * k)
    return retrieve.fuse([near, lexical], k)


def shortened(parts: DataFrame) -> DataFrame:
    """(text, again): the first four tokens of parts that nothing covers, for another try."""
    return parts.select("text", F.array_join(F.slice(tokenize(F.col("text")), 1, 4), " ").alias("again"))


def propose_sources(urls: DataFrame, registry_urls: DataFrame, candidates: DataFrame | None = None, seams: Seams = Seams()) -> DataFrame:
    """Candidate sources among the links that the discovery stage brings for some urls (url)."""
    if seams.discover is None:
        raise ValueError("no discovery stage is set")
    return governance.propose(seams.discover(urls), registry_urls, candidates)


def research(question: str, chunks: DataFrame, sources: DataFrame, profile: Profile, expand: Callable | None = None, most: int = 40, seams: Seams = Seams()) -> Results:
    """Answer a question: hybrid search for its parts, a second try with the first four tokens of parts that nothing
    covers, the best evidence, then the tail. chunks: id (long), chunk_id, source_id, cluster_id, title, text, published_at, entity_ids.
    """
    spark: SparkSession = chunks.sparkSession
    scoped = written(registry.scoped(chunks, sources, profile.include_tags, profile.min_tier), "scoped")
    texts, asked, pending, hits = scoped.select("id", "text"), {}, (seams.plan or plan)(question), None
    for _ in range(profile.max_iterations + 1):
        rows = [(len(asked) + i, q) for i, q in enumerate(pending)]
        asked |= {q: i for i, q in rows}
        q = spark.createDataFrame(rows, "query_id long, text string").withColumn("expanded", expand(F.col("text")) if expand else F.col("text"))
        found = retrieve.covering(search(q, texts, profile.top_k, seams.embed), q.select("query_id", F.col("expanded").alias("text")), texts)
        found = written(found, "hits")
        hits = found if hits is None else hits.unionByName(found)
        bare = retrieve.coverage(q, found).filter("hits = 0").join(q, "query_id").select("text")
        bare = (seams.reflect or shortened)(bare)
        pending = sorted({r.again for r in bare.collect() if r.again and r.again != r.text.lower().strip(" ?.") and r.again not in asked})
        if not pending:
            break
    evidence = written(retrieve.assemble(hits, most).join(scoped, "id"), "evidence")
    return {"hits": hits, "evidence": evidence} | tail(evidence, sources, profile, seams)


def replay(saved_evidence: DataFrame, sources: DataFrame, profile: Profile, verdicts: DataFrame, seams: Seams = Seams()) -> Results:
    """Run the tail again on saved evidence; difference holds the verdicts that only one of the runs has."""
    again = tail(saved_evidence, sources, profile, seams)
    a, b = (t.select("text", "claim_type", "verdict", "sids") for t in (verdicts, again["verdicts"]))
    return again | {"difference": a.exceptAll(b).unionByName(b.exceptAll(a))}
