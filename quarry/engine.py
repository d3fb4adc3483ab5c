"""Searches over a corpus: a query string becomes one Spark plan."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from quarry.capture.extract import with_captures
from quarry.execution import late
from quarry.functions.lines import line_starts, lines, no_hunks
from quarry.operators import lowering, stats
from quarry.operators.lowering import Context
from quarry.plans import query as Q
from quarry.plans.presets import Presets, effective_query
from quarry.plans.rewrite import cost_sorted, metadata_part, unsound_metadata_part, weakened
from quarry.sources.files import Corpus
from quarry.sources.policy import LEFT, gated


class SearchError(RuntimeError):
    """A strict option found a file that it can't accept."""


@dataclass(frozen=True)
class Options:
    """``now`` and ``zone``: what times in queries are measured from. ``drift``: offsets as if every line end took one
    byte. ``unsound_prefilter``: keep an older engine's results for NOT over groups."""

    presets: tuple[str, ...] = ()
    now: datetime | None = None
    zone: str = "UTC"
    semantic_match: str = "exact"
    language: str | None = None
    sql_dialect: str | None = None
    drift: bool = False
    unsound_prefilter: bool = False
    semantic_strict: bool = False
    #: "skip_errors": an unreadable file is a result without content; "fail_fast": it ends the search.
    error_mode: str = "skip_errors"
    #: False: contents are read however large they are and whatever is in them, secrets and binary data included.
    policy: bool = True
    max_semantic_matches: int | None = None
    #: Seconds for the captures of one file; what was found until then counts.
    semantic_budget: float | None = None
    #: A time of the clock, in seconds, after which no further file is looked into: ``results`` then have those files, too,
    #: with the state ``skipped:deadline``.
    deadline: float | None = None
    known_presets: Presets = field(default_factory=Presets)


class Search:
    """One query over one corpus. Each property is a lazy DataFrame; they share their plans' parts, not results."""

    def __init__(self, spark: SparkSession, corpus: Corpus, text: str, options: Options | None = None):
        self.spark, self.corpus, self.options = spark, corpus, options or Options()
        o = self.options
        self.text = effective_query(text, o.presets, o.known_presets)
        self.context = Context(spark, corpus.root, o.now or datetime.now(timezone.utc), o.zone, o.semantic_match)
        self.ast = cost_sorted(Q.parse(self.text))
        lowering.validate(self.ast, self.context)
        self.keys = lowering.needed_captures(self.ast)
        self.reads = lowering.needs_content(self.ast)
        self.observation: Observation | None = None

    def watched(self) -> Observation:
        """Has what is made of the search from now on, by one action, take figures of the files that it looks into: no job of
        their own. ``stats.told(observation.get)`` has them once the action is over."""
        self.observation = Observation()
        return self.observation

    def _watched(self, files: DataFrame) -> DataFrame:
        return files if self.observation is None else files.observe(self.observation, *stats.telemetry(files.columns))

    def _metadata(self) -> Q.Node | bool:
        return (unsound_metadata_part if self.options.unsound_prefilter else metadata_part)(self.ast)

    def _prefilter(self):
        part = self._metadata()
        return F.lit(part) if isinstance(part, bool) else lowering.condition(part, self.context)

    @property
    def candidates(self) -> DataFrame:
        return self.corpus.files

    @property
    def prefiltered(self) -> DataFrame:
        """What the metadata predicates leave, as far as they bound the whole query from above."""
        return self.corpus.narrowed(self._metadata(), self.context).where(self._prefilter()).drop(*self.corpus.internal)

    def _loaded(self, files: DataFrame) -> DataFrame:
        o, end = self.options, self.options.deadline
        loaded = self.corpus.with_content(files, end) if o.policy else self.corpus.with_content(files, end, None)
        return gated(loaded, o.error_mode == "fail_fast" or o.semantic_strict, None if end is None else late(end), o.policy)

    def _or_left(self, condition):
        """What holds a condition, and what the deadline left."""
        return condition if self.options.deadline is None else condition | (F.col("content_state") == LEFT)

    def _read_bound(self, p: Q.Predicate):
        """What metadata and the whole text say about a predicate; True where they say nothing. A regular expression that
        is tested line by line still needs its literal text."""
        if p.key in Q.METADATA_KEYS:
            return p
        if p.key not in Q.CONTENT_KEYS:
            return True
        return p if lowering.text_bound(p, self.context) is not None else lowering.required_text(p, self.context) or True

    def _evaluated(self, files: DataFrame, strict: bool | None = None) -> DataFrame:
        """Adds the columns that conditions read. Texts that content predicates rule out are not tokenized."""
        override = {"generic": "sql", "postgres": "sqlpg", "mysql": "sqlmysql", "sqlite": "sqlsqlite"}.get(self.options.sql_dialect or "", self.options.language)
        out = self._loaded(files)
        content = any(p.key in Q.CONTENT_KEYS for p in Q.predicates(self.ast))
        by_line = any(p.key == "matches" and lowering.text_bound(p, self.context) is None for p in Q.predicates(self.ast))
        if content and (self.keys or by_line) and not self.options.unsound_prefilter:
            part = weakened(self.ast, self._read_bound)
            out = out.where(self._or_left(F.lit(part) if isinstance(part, bool) else lowering.condition(part, self.context)))
        if self.keys:
            out = with_captures(out.drop("low"), self.keys, override, self.options.semantic_strict if strict is None else strict, self.options.semantic_budget, self.options.deadline)
            if content:
                out = out.withColumn("low", F.lower("text"))
        out = self._watched(out)
        if content:
            out = out.withColumn("lines", lines(F.col("text")))
        return out

    @property
    def matched(self) -> DataFrame:
        """Matching files with their metadata. Content is read only if a predicate asks for it."""
        found = self.found
        if self.reads and self.options.deadline is not None:
            found = found.where(F.col("content_state") != LEFT)
        return found.drop("content_state", "changed")

    @property
    def found(self) -> DataFrame:
        """The same, with the state of their content if it was read, and what the deadline left."""
        files = self.prefiltered
        if self.reads:
            files = self._evaluated(files).where(self._or_left(lowering.condition(self.ast, self.context)))
        return files.drop("text", "low", "content", "lines", "captures", "supported", "profile", "exhausted")

    @property
    def results(self) -> DataFrame:
        """Matching files with ``whole``, ``hunks``, ``text``, ``content_state``, and ``changed``: what differs from the
        listing (null: nothing)."""
        files = self._evaluated(self.prefiltered) if self.reads else self._watched(self._loaded(self.prefiltered))
        files = files.where(self._or_left(lowering.condition(self.ast, self.context)))
        if "changed" not in files.columns:
            files = files.withColumn("changed", F.lit(None).cast("string"))
        if "lines" in files.columns:
            files = files.withColumn("starts", line_starts(F.col("text"), self.options.drift))
        plan = lowering.Lowering(self.context)
        r = plan.node(self.ast)
        made = files
        for step in plan.steps:
            made = made.withColumns(step)
        hunks = r.hunks if self.options.max_semantic_matches is None else F.slice(r.hunks, 1, self.options.max_semantic_matches)
        whole = r.whole
        if self.options.deadline is not None:
            whole, hunks = whole & (F.col("content_state") != LEFT), F.when(F.col("content_state") == LEFT, no_hunks()).otherwise(hunks)
        out = made.withColumn("whole", whole).withColumn("hunks", hunks).drop(*(name for step in plan.steps for name in step))
        skips = F.when(F.col("content_state").startswith("skipped:"), F.array(F.lit("content_unavailable"))).otherwise(F.array())
        if self.keys:
            skips = F.when(F.col("profile").isNull(), F.array_append(skips, "unsupported_language")).when(F.col("exhausted"), F.array_append(skips, "budget_exhausted")).otherwise(skips)
        return out.withColumn("skip_reasons", skips.cast("array<string>")).drop("low", "lines", "starts", "captures", "supported", "profile", "exhausted")

    @property
    def paths(self) -> DataFrame:
        return self.matched.select("display_path")

    def strict_check(self) -> None:
        """Raises if a file that the metadata leaves has a language without captures."""
        if self.options.semantic_strict and self.keys:
            bad = self._evaluated(self.prefiltered, strict=False).where("profile is null").select("display_path").head()
            if bad:
                raise SearchError(f"Unsupported language for semantic predicates: {bad[0]}")


class Engine:
    """``Engine(spark, corpus).search("ext:rs & contains:todo")``."""

    def __init__(self, spark: SparkSession, corpus: Corpus, options: Options | None = None):
        self.spark, self.corpus, self.options = spark, corpus, options or Options()

    def search(self, text: str, **changes) -> Search:
        return Search(self.spark, self.corpus, text, replace(self.options, **changes))
