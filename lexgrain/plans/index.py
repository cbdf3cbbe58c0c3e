"""An index over documents: build, save, load and search."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property, lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexgrain.operators import fusion, lexical, parse, toc, vectors
from lexgrain.operators.agentic import Search
from lexgrain.runtime import materialise
from lexgrain.sources import store

METHODS, STRATEGIES = ("bm25", "vector", "hybrid"), ("flat", "tree")


def pipeline(docs: DataFrame, size: int = 1500, overlap: int = 150, misread: bool = True) -> dict[str, DataFrame]:
    """Tables of an index from ``documents`` (doc_id, md_text ...): sections, clauses, units."""
    of = parse.lines(docs, "doc_id", "md_text")
    sections = materialise(parse.sections(of, "doc_id"))
    raw = materialise(parse.split_inline(parse.segments(docs, "doc_id", "md_text", misread), "doc_id"))
    clauses = materialise(parse.ordinals(raw, "doc_id", "span_start", "span_end", name="clause_id"))
    spans = clauses.select(
        "doc_id", "clause_id", "section_key", "text", F.posexplode(parse.window_spans(F.length("text"), size, overlap)).alias("_w", "s")
    )
    units = parse.ordinals(
        spans.select(
            "doc_id", "clause_id", "section_key", "_w", "s.span_start", "s.span_end",
            F.substring("text", F.col("s.span_start").cast("int") + 1, (F.col("s.span_end") - F.col("s.span_start")).cast("int")).alias("text"),
        ),
        "doc_id", "clause_id", "_w", name="unit_id",
    ).drop("_w")
    return {"documents": docs, "sections": sections, "clauses": clauses, "units": materialise(units)}


@dataclass
class Index:
    """Tables of an index with the searches over them.

    Beside the tables of :func:`pipeline` an index may hold ``vectors`` (unit_id, vec); the
    lexical index (``postings``, ``terms``) is made when it is first wanted, and kept.
    """

    tables: dict[str, DataFrame]
    facts: dict = field(default_factory=dict)
    normaliser: str = "none"

    @classmethod
    def build(cls, docs: DataFrame, normaliser: str = "auto", **how) -> Index:
        return cls(pipeline(docs, **how), normaliser=lexical.resolve_normaliser(normaliser))

    @classmethod
    def load(cls, spark: SparkSession, root: str, normaliser: str | None = None) -> Index:
        """A saved index; with another normaliser than its own, words are indexed anew."""
        tables, facts = store.load(spark, root), store.manifest(spark, root)
        kept = facts.get("lexical", {})
        own = kept.get("normaliser", "none")
        wanted = own if normaliser is None else lexical.resolve_normaliser(normaliser)
        if wanted != own:
            tables = {n: d for n, d in tables.items() if n not in ("postings", "terms")}
        return cls(tables, facts, wanted)

    def save(self, spark: SparkSession, root: str) -> None:
        slim = {n: d.drop("text") if n in ("clauses", "units") else d for n, d in self.tables.items()}
        facts = {"lexical": self.terms.facts()}
        if "vectors" in slim:
            facts["vectors"] = {"dim": self.dimension}
        store.save(spark, root, slim | self.terms.tables(), facts)

    @cached_property
    def terms(self) -> lexical.LexicalIndex:
        if "postings" in self.tables:
            return lexical.LexicalIndex.of(self.tables, self.facts["lexical"])
        return lexical.build(self.tables["units"], "unit_id", "text", normaliser=self.normaliser)

    @cached_property
    def dimension(self) -> int:
        """Length of the index's vectors; vectors of several lengths, or not one for each unit, are an error."""
        found = self.unit_vectors.agg(F.min(F.size("vec")), F.max(F.size("vec")), F.count("*")).first()
        if found[0] != found[1] or found[2] != self.tables["units"].count():
            raise ValueError("the vectors don't fit the index: one of the same length is due for each unit")
        return found[0] or 0

    def _fits(self, query_vectors: DataFrame) -> None:
        odd = query_vectors.where(F.size("vec") != self.dimension).limit(1).count()
        if odd:
            raise ValueError(f"query vectors must have {self.dimension} dimensions, as the index")

    @cached_property
    def unit_vectors(self) -> DataFrame:
        if "vectors" not in self.tables:
            raise RuntimeError("this search needs vectors; the index has none")
        return self.tables["vectors"]

    def section_vectors(self, mode: str = "mean", embedder=None, lead: int = 400) -> DataFrame:
        """``doc_id``, ``section_key``, ``vec`` of length 1 for each section.

        ``mean``: of the vectors of units whose clause lies in the section; sections
        without one have none.  ``title_lead``: the embedder's vector of the title
        and the first characters of the section, heading included.
        """
        docs, sections = self.tables["documents"], self.tables["sections"]
        spans = parse.section_spans(parse.lines(docs, "doc_id", "md_text"), sections, "doc_id")
        if mode == "mean":
            clauses = self.tables["clauses"].select("clause_id", "doc_id", "span_start", "span_end")
            inside = parse.contained(clauses, spans, "doc_id")
            rows = inside.join(self.tables["units"].select("clause_id", "unit_id"), "clause_id").join(self.unit_vectors, "unit_id")
            pooled = vectors.pool(rows.withColumn("_s", F.struct("doc_id", "line_start", "in_section")), "_s")
            return pooled.select("_s.doc_id", F.col("_s.in_section").alias("section_key"), "vec")
        if mode != "title_lead":
            raise ValueError(f"mode must be 'mean' or 'title_lead', got {mode!r}")
        cut = F.substring(F.col("md_text"), (F.col("span_start") + 1).cast("int"), F.least(F.col("span_end") - F.col("span_start"), F.lit(lead)).cast("int"))
        texts = spans.join(docs.select("doc_id", "md_text"), "doc_id").withColumn("_t", F.concat("title", F.lit("\n"), cut))
        named = texts.where(fusion.X.strip(cut) != "").select(F.to_json(F.struct("doc_id", "section_key")).alias("k"), "_t")
        made = vectors.embed(named, "k", "_t", embedder)
        key = F.from_json("k", "doc_id string, section_key string")
        return made.select(key.alias("_k"), vectors.normalise(F.col("vec")).alias("vec")).select("_k.doc_id", "_k.section_key", "vec")

    def find_section(self, query_vectors: DataFrame, k: int = 3) -> DataFrame:
        """Sections nearest each query by meaning: ``query_id``, ``doc_id``, ``section_key``,
        ``title``, ``score``, ``rank``.  An index whose sections have no vectors finds none."""
        self._fits(query_vectors)
        rows = self.section_vectors().withColumn("section_no", F.xxhash64("doc_id", "section_key"))
        rows = materialise(rows)
        near = vectors.rank(query_vectors, rows.select("section_no", "vec"), "section_no", k)
        entries = toc.entries(self.tables["documents"], "doc_id", "md_text", self.tables["clauses"], 80)
        titles = entries.groupBy("doc_id", "section_key").agg(F.min_by("title", "line_start").alias("title"))
        found = near.join(rows.select("section_no", "doc_id", "section_key"), "section_no")
        return found.join(titles, ["doc_id", "section_key"], "left").select("query_id", "doc_id", "section_key", "title", "score", "rank")

    def asker(self, spark: SparkSession, embedder=None, method: str | None = None) -> dict[str, Search]:
        """The searches that :func:`agentic_search` wants, over this index: ``search``, ``grep``
        and, with vectors and an embedder, ``scoped`` (within the section nearest by meaning).

        Base method: ``hybrid`` with vectors and an embedder, else ``bm25``.
        """
        meaning = "vectors" in self.tables and embedder is not None
        method = method or ("hybrid" if meaning else "bm25")
        vector = lru_cache(maxsize=256)(lambda text: tuple(float(x) for x in embedder([text])[0]))

        def asked(text: str) -> tuple[DataFrame, DataFrame | None]:
            one = spark.createDataFrame([(1, text)], "query_id long, text string")
            vec = spark.createDataFrame([(1, list(vector(text)))], "query_id long, vec array<double>") if meaning else None
            return one, vec

        def rows(found: DataFrame) -> list[tuple[int, float, str]]:
            texts = found.join(self.tables["clauses"].select("clause_id", "text"), "clause_id")
            return [(r.clause_id, float(r.score), r.text) for r in texts.orderBy("rank").collect()]

        def search(text: str, k: int, **scope) -> list:
            one, vec = asked(text)
            return rows(self.search(one, method, k, query_vectors=vec, **scope))

        def grep(pattern: str, k: int) -> list:
            found = fusion.grep(self.tables["clauses"], pattern).orderBy(F.desc("score"), "clause_id").limit(k)
            return [(r.clause_id, float(r.score), r.text) for r in found.collect()]

        def scoped(text: str, k: int) -> list:
            nearest = self.find_section(asked(text)[1], 1).where("section_key <> ''").first()
            return search(text, k, doc=nearest.doc_id, section=nearest.section_key) if nearest else []

        return {"search": search, "grep": grep} | ({"scoped": scoped} if meaning else {})

    def search(
        self,
        queries: DataFrame,
        method: str = "bm25",
        k: int = 5,
        strategy: str = "flat",
        doc: str | None = None,
        section: str | None = None,
        query_vectors: DataFrame | None = None,
    ) -> DataFrame:
        """Ranked clauses of each query (query_id, text): ``query_id``, ``clause_id``, ``score``, ``rank``.

        Units are over-fetched (``max(5k, 50)``), clauses take their best unit's
        score, hybrid fuses the two clause rankings.  ``strategy="tree"`` restricts
        the units to the numbering scopes of the eight nearest sections.
        """
        if method not in METHODS:
            raise ValueError(f"method must be one of {METHODS}, got {method!r}")
        if strategy not in STRATEGIES:
            raise ValueError(f"strategy must be one of {STRATEGIES}, got {strategy!r}")
        if query_vectors is not None:
            self._fits(query_vectors)
        depth = max(5 * k, 50)
        units, clauses = self.tables["units"], self.tables["clauses"]
        allowed = None
        if doc is not None:
            allowed = clauses.where(F.col("doc_id") == doc)
        if section is not None:
            scope = clauses.select("doc_id").distinct().withColumn("section_key", F.lit(section))
            allowed = fusion.in_scope(allowed if allowed is not None else clauses, scope, "doc_id")
        if strategy == "tree":
            if query_vectors is None:
                raise RuntimeError("strategy 'tree' needs query vectors")
            rows = self.section_vectors().withColumn("section_no", F.xxhash64("doc_id", "section_key"))
            near = vectors.rank(query_vectors, rows.select("section_no", "vec"), "section_no", 8)
            scope = near.join(rows.select("section_no", "doc_id", "section_key"), "section_no")
            allowed = fusion.in_scope(allowed if allowed is not None else clauses, scope, "doc_id")
        inside = units if allowed is None else units.join(allowed.select("clause_id"), "clause_id", "left_semi")
        rankings = []
        if method in ("bm25", "hybrid"):
            scored = lexical.asked(self.terms, queries, "query_id", "text")
            if allowed is not None:
                scored = scored.join(inside.select("unit_id"), "unit_id", "left_semi")
            rankings.append(fusion.by_clause(lexical.top(scored, depth), units))
        if method in ("vector", "hybrid"):
            if query_vectors is None:
                raise RuntimeError(f"method {method!r} needs query vectors")
            pool = self.unit_vectors.join(inside.select("unit_id"), "unit_id", "left_semi")
            rankings.append(fusion.by_clause(vectors.rank(query_vectors, pool, "unit_id", depth), units))
        if method == "hybrid":
            fused = fusion.rrf([(fusion.ranked(r, "clause_id"), 1.0) for r in rankings], "clause_id")
        else:
            fused = rankings[0]
        return fusion.ranked(fused, "clause_id").where(F.col("rank") <= k)
