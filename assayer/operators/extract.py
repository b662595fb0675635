"""Text to facts.

The whole extraction of a record is one narrow projection over its sentence
array: each pattern runs once per sentence, and every later figure is derived
from those per-sentence facts with array functions. No record is exploded,
shuffled and re-assembled, so the job scales with the scan alone and a single
very long text stays one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DomainProfile, Registry
from ..config.defaults import AUTHORITY_TIERS, SPARSE_IGNORED_PHASES
from ..functions.arrays import distinct_ordered, or_empty, string_array
from ..functions.text import PatternSet, alias_pattern, compile_pattern, matches, matches_any, quoted, required_literals, sentences

EXCERPT = "struct<label:string,text:string,source:string,confidence:double,reviewed:boolean>"

# Confidences of the evidence each detector leaves behind.
FAMILY_CONFIDENCE = 0.9
TITLE_CONFIDENCE, SENTENCE_CONFIDENCE = 0.9, 0.8
CHEMICAL_CONFIDENCE, MENTION_CONFIDENCE, OUTCOME_CONFIDENCE = 0.85, 0.7, 0.8
EXCERPT_CONFIDENCE = 0.92
SPECIMEN_KEEP, SPECIMEN_FALLBACK = 2.5, 2
# Entries of a dictionary that are tested under one bit mask; characters in which a quote of the family is looked for first.
PART, OPENING = 8, 1000

# Notes that mark a curated record as second-hand, labels of direct evidence.
SECONDARY_NOTES = r"(?i)secondary-source|secondary rather than the original|secondary review"
DIRECT_LABELS = r"(?i)results|viability|function|transplant|survival|recovery|yield|morpholog|histolog"


def reviewed_excerpts(status: Column, excerpts: Column) -> Column:
    usable = F.filter(excerpts, lambda e: e.reviewed & (F.trim(e.text) != ""))
    return F.when(status == "reviewed", usable).otherwise(F.array().cast(f"array<{EXCERPT}>"))


def attach_reviewed_enrichment(papers: DataFrame, enrichment: DataFrame) -> DataFrame:
    """The first reviewed curated record of each paper, on paper_id.

    ``enrichment`` carries ``ord`` (its place in the file). Reducing it to one row
    per paper before the join keeps a much-curated paper out of a single task.
    """
    first = (
        enrichment.where("status = 'reviewed'")
        .groupBy("domain", "paper_id")
        .agg(F.min_by(F.struct("excerpts", "reviewer_notes", "status"), "ord").alias("e"))
        .select("domain", "paper_id", "e.excerpts", "e.reviewer_notes", F.col("e.status").alias("enrichment_status"))
    )
    return papers.join(first, ["domain", "paper_id"], "left")


def _with_enrichment_columns(papers: DataFrame) -> DataFrame:
    types = {"excerpts": f"array<{EXCERPT}>", "reviewer_notes": "string", "enrichment_status": "string"}
    for name, kind in types.items():
        if name not in papers.columns:
            papers = papers.withColumn(name, F.lit(None).cast(kind))
    return papers


def augment_source_text(papers: DataFrame, registry: Registry) -> DataFrame:
    """Adds ``source_text``: the domain's prefix, title, abstract and reviewed excerpts."""
    papers = _with_enrichment_columns(papers)
    prefix = registry.by_domain(F.col("domain"), lambda d: F.lit(d.text_prefix))
    usable = or_empty(reviewed_excerpts(F.col("enrichment_status"), F.col("excerpts")), EXCERPT)
    parts = F.concat(
        F.array(F.col("title"), F.coalesce("abstract", F.lit(""))),
        F.transform(usable, lambda e: F.concat(e.label, F.lit(": "), e.text)),
    )
    body = F.array_join(F.filter(parts, lambda p: F.trim(p) != ""), " ")
    return papers.withColumn("_excerpts", usable).withColumn("source_text", F.concat(prefix, F.lit(". "), body))


def explode_sentences(df: DataFrame, text: str) -> DataFrame:
    """(…, pos, sentence) in reading order."""
    return df.select("*", F.posexplode(sentences(F.col(text))).alias("pos", "sentence"))


def protocol_family(title: Column, abstract: Column, registry: Registry) -> Column:
    """struct(family, evidence sentences) over title and abstract."""
    shared = registry.shared
    hay = F.concat(title, F.lit(". "), F.coalesce(abstract, F.lit("")))
    lowered = F.lower(hay)
    vitrified, slow = matches(hay, shared.vitrification, lowered), matches(hay, shared.slow_freezing, lowered)
    none = F.array().cast("array<string>")
    family = (
        F.when(vitrified & slow, "comparative")
        .when(vitrified, "vitrification")
        .when(slow, "slow-freezing")
        .otherwise("unknown")
    )

    def first(text: Column, flag: Column, pattern: str) -> Column:
        return F.when(flag, F.slice(F.filter(sentences(text), lambda s: matches(s, pattern, F.lower(s))), 1, 1)).otherwise(none)

    # whole sentences of the opening are sentences of the text; the text is split only if they hold no quote
    opening = F.when(F.length(hay) > OPENING, F.regexp_extract(F.substring(hay, 1, OPENING), r"(?s)^.*[.!?](?=[\s\xa0])", 0)).otherwise(hay)

    def quote(flag: Column, pattern: str) -> Column:
        return _once(first(opening, flag, pattern), lambda q: F.when(flag & (F.size(q) == 0), first(hay, flag, pattern)).otherwise(q))

    evidence = F.concat(quote(vitrified, shared.vitrification), quote(slow, shared.slow_freezing))
    return F.struct(family.alias("family"), evidence.alias("evidence"))


def paper_type(title: Column, abstract: Column, registry: Registry, domain: Column) -> Column:
    """review, methods, commentary, experimental or unknown; the first rule wins."""
    shared = registry.shared
    raw_abstract = F.coalesce(abstract, F.lit(""))
    low_abstract = F.lower(raw_abstract)
    text = F.concat(F.lower(title), F.lit(" "), low_abstract)

    def classify(d: DomainProfile) -> Column:
        by_rule = F.lit(False)
        for rule in d.experimental_rules:
            every = F.lit(True)
            for pattern in rule:
                every = every & matches(text, pattern, text)
            by_rule = by_rule | every
        experimental = (*shared.experimental_patterns, *d.extra_experimental)
        return (
            F.when(matches_any(text, (*shared.review_patterns, *d.extra_review), text), "review")
            .when(matches_any(text, (*shared.methods_patterns, *d.extra_methods), text), "methods")
            .when(matches_any(text, shared.commentary_patterns, text), "commentary")
            .when(matches_any(raw_abstract, experimental, low_abstract), "experimental")
            .when(by_rule, "experimental")
            .otherwise("unknown")
        )

    return registry.by_domain(domain, classify)


def _sentence_patterns(d: DomainProfile, registry: Registry) -> list[str]:
    """Every dictionary pattern that is looked for in a sentence."""
    shared = registry.shared
    return [
        shared.process_context, shared.stepwise,
        *[s.pattern for s in d.specimens],
        *[pattern for _, pattern in shared.species],
        *[alias_pattern(alias) for chemical in registry.chemicals(d) for alias in chemical.aliases],
        *[p for rule in d.outcomes for p in rule.patterns],
        *[p for p in (shared.study_terms, d.outcome_terms, shared.preserving_terms) if p],
        *[p for rule in registry.phases(d) for p in rule.patterns],
    ]


def _sentence_facts(d: DomainProfile, registry: Registry, patterns: PatternSet) -> str:
    """SQL: everything the detectors need to know about one sentence ``s``.

    It carries text, whether it has a digit, and which patterns may match (words of bits). A list is looked at only where
    the bits of one of its patterns are set, and a long one in parts (``PART``).
    """
    shared = registry.shared

    def found(pattern: str) -> str:
        return patterns.found("s.text", "s.m", pattern)

    def any_found(some) -> str:
        return "(" + (" OR ".join(map(found, some)) or "false") + ")"

    def listed(kind: str, items: list[tuple[str, tuple[str, ...]]]) -> str:
        """The values whose patterns are found, in order."""
        none = f"cast(array() as array<{kind}>)"
        parts = [items[i : i + PART] for i in range(0, len(items), PART)]
        some = [
            f"CASE WHEN {patterns.touched('s.m', [p for _, own in part for p in own])} THEN array_compact(array("
            + ", ".join(f"CASE WHEN {any_found(own)} THEN {value} END" for value, own in part)
            + f")) ELSE {none} END"
            for part in parts
        ]
        if len(some) <= 1:
            return f"cast({some[0]} as array<{kind}>)" if some else none
        return f"CASE WHEN {patterns.touched('s.m', [p for _, own in items for p in own])} THEN cast(concat({', '.join(some)}) as array<{kind}>) ELSE {none} END"

    def labels(pairs: list[tuple[str, tuple[str, ...]]]) -> str:
        return listed("string", [(quoted(label), own) for label, own in pairs])

    none = "cast(array() as array<string>)"
    alias = "struct<name:string,alias:string>"
    aliases = [
        (f"named_struct('name', {quoted(c.name)}, 'alias', {quoted(a)})", (alias_pattern(a),)) for c in registry.chemicals(d) for a in c.aliases
    ]
    study_terms = [p for p in (shared.study_terms, d.outcome_terms, shared.preserving_terms) if p]
    # the outcomes come first: few sentences have one, and the study terms are the longest patterns
    outcomes = labels([(str(i), tuple(rule.patterns)) for i, rule in enumerate(d.outcomes)])
    when_touched = {
        "process": found(shared.process_context),
        "stepwise": found(shared.stepwise),
        "specimens": labels([(x.label, (x.pattern,)) for x in d.specimens]),
        "species": labels([(label, (pattern,)) for label, pattern in shared.species]),
        "aliases": listed(alias, aliases),
        "outcomes": f"get(transform(array({outcomes}), o -> CASE WHEN size(o) > 0 AND {any_found(study_terms)} THEN o ELSE {none} END), 0)",
        "phases": labels([(r.phase, tuple(r.patterns)) for r in registry.phases(d)]),
    }
    otherwise = dict.fromkeys(when_touched, none) | {"process": "false", "stepwise": "false", "aliases": f"cast(array() as array<{alias}>)"}
    measured = {
        field: f"CASE WHEN s.digit THEN regexp_extract_all(s.text, {quoted(compile_pattern(pattern))}, 0) ELSE {none} END"
        for field, pattern in (
            ("concentrations", shared.concentration), ("temperatures", shared.temperature), ("durations", shared.duration), ("rates", shared.rate)
        )
    }

    def struct(dictionary: dict[str, str]) -> str:
        return "named_struct('text', s.text, " + ", ".join(f"'{k}', {v}" for k, v in {**dictionary, **measured}.items()) + ")"

    if not all(required_literals(p) for p in _sentence_patterns(d, registry)):
        return struct(when_touched)
    touched = " OR ".join(f"s.m{w} != 0" for w in range(patterns.words)) or "false"
    return f"CASE WHEN {touched} THEN {struct(when_touched)} ELSE {struct(otherwise)} END"


def sentence_facts(papers: DataFrame, registry: Registry) -> DataFrame:
    """Adds ``facts``: one struct per sentence of ``source_text``.

    One pass over a sentence finds the literals of its domain's dictionaries; a pattern runs only where one of its literals stands.
    """
    if "source_text" not in papers.columns:
        papers = augment_source_text(papers, registry)
    split = papers.withColumn("_sentences", sentences(F.col("source_text")))

    def facts(d: DomainProfile) -> Column:
        patterns = PatternSet(_sentence_patterns(d, registry))
        hit = f"transform(_sentences, s -> named_struct('text', s, 'hits', {patterns.masks(patterns.hits('lower(s)'))}, 'digit', rlike(s, '[0-9]')))"
        marked = ", ".join(["'text', s.text", "'digit', s.digit", *(f"'m{w}', {patterns.marked(w, 's.hits')}" for w in range(patterns.words))])
        return F.expr(f"transform(transform({hit}, s -> named_struct({marked})), s -> {_sentence_facts(d, registry, patterns)})")

    # a generator, so that no later filter is pushed below it as a second copy
    # of every pattern
    return split.select("*", F.explode(F.array(registry.by_domain(F.col("domain"), facts))).alias("facts"))


def _once(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), 0)


def _specimen_rules(d: DomainProfile, title: Column) -> Column:
    """array<struct<label, weight, titled>> in dictionary order."""
    lowered = F.lower(title)
    return F.array(
        *[
            F.struct(F.lit(s.label).alias("label"), F.lit(float(s.weight)).alias("weight"), matches(lowered, s.pattern, lowered).alias("titled"))
            for s in d.specimens
        ]
    )


def rank_specimens(rules: Column, facts: Column) -> Column:
    """Specimen labels ranked by weighted hits, one more inside process context; weak ones only when nothing is strong."""

    def ranked(held: Column) -> Column:
        def scored(r: Column) -> Column:
            inside = F.filter(held, lambda f: F.array_contains(f.specimens, r.label))
            hits = F.aggregate(inside, F.lit(0.0), lambda acc, f: acc + r.weight + F.when(f.process, 1.0).otherwise(0.0))
            return F.struct((-(F.when(r.titled, r.weight + 2.0).otherwise(0.0) + hits)).alias("score"), r.label.alias("label"))

        return F.array_sort(F.filter(F.transform(rules, scored), lambda x: x.score < 0))

    def chosen(all_: Column) -> Column:
        def strongest(strong: Column) -> Column:
            return F.when(F.size(strong) > 0, strong).otherwise(F.slice(all_, 1, SPECIMEN_FALLBACK))

        return F.transform(_once(F.filter(all_, lambda x: x.score <= -SPECIMEN_KEEP), strongest), lambda x: x.label)

    return _once(_once(F.filter(facts, lambda f: F.size(f.specimens) > 0), ranked), chosen)


def _species_rules(registry: Registry, title: Column) -> Column:
    """array<struct<label, titled>> in dictionary order."""
    lowered = F.lower(title)
    return F.array(
        *[F.struct(F.lit(label).alias("label"), matches(title, pattern, lowered).alias("titled")) for label, pattern in registry.shared.species]
    )


def detect_species(rules: Column, facts: Column) -> Column:
    def found(said: Column) -> Column:
        return F.transform(F.filter(rules, lambda r: r.titled | F.array_contains(said, r.label)), lambda r: r.label)

    return _once(F.array_distinct(F.flatten(F.transform(facts, lambda f: f.species))), found)


def extract_chemicals(names: Column, facts: Column) -> Column:
    """array<struct<name, aliases, concentrations, sentences>> in dictionary order."""

    def mentions(held: Column) -> Column:
        def mention(name: Column) -> Column:
            def of(hit: Column) -> Column:
                own = F.flatten(F.transform(hit, lambda f: F.filter(f.aliases, lambda a: a["name"] == name)))
                return F.struct(
                    name.alias("name"),
                    F.array_distinct(F.transform(own, lambda a: a["alias"])).alias("aliases"),
                    distinct_ordered(F.flatten(F.transform(hit, lambda f: f.concentrations))).alias("concentrations"),
                    F.transform(hit, lambda f: f.text).alias("sentences"),
                )

            return _once(F.filter(held, lambda f: F.exists(f.aliases, lambda a: a["name"] == name)), of)

        said = F.array_distinct(F.flatten(F.transform(held, lambda f: F.transform(f.aliases, lambda a: a["name"]))))
        return F.transform(_once(said, lambda s: F.filter(names, lambda n: F.array_contains(s, n))), mention)

    return _once(F.filter(facts, lambda f: F.size(f.aliases) > 0), mentions)


def extract_mentions(facts: Column, field: str) -> Column:
    """Distinct mention strings in order."""
    return distinct_ordered(F.flatten(F.transform(facts, lambda f: f[field])))


def _outcome_rules(d: DomainProfile) -> Column:
    return F.array(
        *[
            F.struct(
                F.lit(str(i)).alias("rule"),
                F.lit(r.outcome_class).alias("outcome_class"),
                F.lit(r.strength).alias("strength"),
            )
            for i, r in enumerate(d.outcomes)
        ]
    )


def extract_outcomes(rules: Column, facts: Column) -> Column:
    """array<struct<outcome_class, strength, summary, sentences>> in rule order."""

    def mentions(held: Column) -> Column:
        def mention(rule: Column) -> Column:
            def of(found: Column) -> Column:
                return F.struct(
                    rule.outcome_class.alias("outcome_class"),
                    rule.strength.alias("strength"),
                    F.get(found, 0).alias("summary"),
                    found.alias("sentences"),
                )

            hit = F.filter(held, lambda f: F.array_contains(f.outcomes, rule.rule))
            return _once(F.array_distinct(F.transform(hit, lambda f: f.text)), of)

        return F.filter(F.transform(rules, mention), lambda o: F.size(o.sentences) > 0)

    return _once(F.filter(facts, lambda f: F.size(f.outcomes) > 0), mentions)


def extract_steps(facts: Column) -> Column:
    """One step per (sentence, phase) of procedural sentences, numbered in reading order."""

    def measured(f: Column) -> Column:
        return (F.size(f.concentrations) > 0) | (F.size(f.temperatures) > 0) | (F.size(f.rates) > 0)

    procedural = F.filter(
        facts,
        lambda f: f.process & (F.size(f.phases) > 0) & (measured(f) | (F.size(f.durations) > 0) | f.stepwise),
    )

    def steps_of(f: Column) -> Column:
        strong = (F.size(f.phases) >= 2) & measured(f)
        return F.transform(
            f.phases,
            lambda phase: F.struct(
                phase.alias("phase"),
                f.text.alias("summary"),
                F.array_distinct(F.transform(f.aliases, lambda a: a["name"])).alias("chemicals"),
                f.concentrations.alias("concentrations"),
                distinct_ordered(F.concat(f.temperatures, f.rates)).alias("temperatures"),
                f.durations.alias("durations"),
                F.when(phase == "assessment", 0.72).when(strong, 0.9).otherwise(0.82).alias("confidence"),
            ),
        )

    # a repeated sentence yields identical structs, so distinct keeps the first
    steps = F.array_distinct(F.flatten(F.transform(procedural, steps_of)))
    return F.transform(
        steps,
        lambda s, i: F.struct(
            i.cast("int").alias("order"),
            *[s[n].alias(n) for n in
              ("phase", "summary", "chemicals", "concentrations", "temperatures", "durations", "confidence")],
        ),
    )


def _snippets(kind: str, levels: tuple[float, ...], marked: Column) -> Column:
    """Distinct snippets of one kind, in detector order, from texts behind the place of their confidence in ``levels``.

    Repeats are dropped on plain strings, which Spark hashes; arrays of structs would be compared pair by pair.
    """
    confidence = F.array(*[F.lit(c) for c in levels])
    return F.transform(
        F.array_distinct(marked),
        lambda k: F.struct(
            F.lit(kind).alias("kind"),
            F.substring(k, 2, 2147483646).alias("text"),
            F.get(confidence, F.substring(k, 1, 1).cast("int")).alias("confidence"),
            F.lit("title-or-abstract").alias("source_type"),
            F.lit("primary-indirect").alias("tier"),
            F.lit("direct").alias("explicitness"),
            F.lit(False).alias("reviewed"),
        ),
    )


def _marked(texts: Column, level: int = 0) -> Column:
    return F.transform(texts, lambda t: F.concat(F.lit(str(level)), F.trim(t)))


def enrichment_evidence(excerpts: Column, reviewer_notes: Column) -> Column:
    """Reviewed excerpts as evidence snippets."""
    secondary = matches(F.coalesce(reviewer_notes, F.lit("")), SECONDARY_NOTES)
    record_tier = F.when(secondary, "secondary").otherwise("manual-curation")

    def tier(e: Column) -> Column:
        return (
            F.when(e.source.isin("full-text", "methods", "results"), F.when(secondary, "secondary").otherwise("primary-direct"))
            .when(e.source == "discussion", F.when(secondary, "secondary").otherwise("primary-indirect"))
            .otherwise(record_tier)
        )

    return F.transform(
        excerpts,
        lambda e: F.struct(
            F.lit("source-enrichment").alias("kind"),
            F.trim(F.concat(e.label, F.lit(": "), e.text)).alias("text"),
            F.coalesce(e.confidence, F.lit(EXCERPT_CONFIDENCE)).alias("confidence"),
            e.source.alias("source_type"),
            tier(e).alias("tier"),
            F.when(matches(e.label, DIRECT_LABELS), "direct").otherwise("indirect").alias("explicitness"),
            F.lit(True).alias("reviewed"),
        ),
    )


def collect_evidence(specimens: Column, species: Column) -> Column:
    """All evidence of a record in detector order, exact repeats dropped; the rules are those of its domain."""
    facts, title = F.col("facts"), F.col("title")
    none = F.array().cast("array<string>")
    levels = (SENTENCE_CONFIDENCE, TITLE_CONFIDENCE)

    def specimen(held: Column) -> Column:
        def of(r: Column) -> Column:
            in_text = F.transform(F.filter(held, lambda f: F.array_contains(f.specimens, r.label)), lambda f: f.text)
            return F.concat(F.when(r.titled, _marked(F.array(title), 1)).otherwise(none), _marked(in_text))

        return F.flatten(F.transform(specimens, of))

    def kind_of_animal(held: Column) -> Column:
        def of(r: Column) -> Column:
            first = F.slice(F.filter(held, lambda f: F.array_contains(f.species, r.label)), 1, 1)
            return F.when(r.titled, _marked(F.array(title), 1)).otherwise(_marked(F.transform(first, lambda f: f.text)))

        return F.flatten(F.transform(species, of))

    def texts_with(field: str) -> Column:
        return F.transform(F.filter(facts, lambda f: F.size(f[field]) > 0), lambda f: f.text)

    bodies = F.concat(
        _once(F.filter(facts, lambda f: F.size(f.specimens) > 0), specimen),
        _once(F.filter(facts, lambda f: F.size(f.species) > 0), kind_of_animal),
    )
    chemical = F.flatten(F.transform("chemical_mentions", lambda c: c.sentences))
    outcome = F.flatten(F.transform("outcome_mentions", lambda o: o.sentences))
    return F.concat(
        _snippets("protocol-family", (FAMILY_CONFIDENCE,), _marked(F.col("_family.evidence"))),
        _snippets("specimen", levels, bodies),
        _snippets("chemical", (CHEMICAL_CONFIDENCE,), _marked(chemical)),
        _snippets("temperature", (MENTION_CONFIDENCE,), _marked(texts_with("temperatures"))),
        _snippets("duration", (MENTION_CONFIDENCE,), _marked(texts_with("durations"))),
        _snippets("outcome", (OUTCOME_CONFIDENCE,), _marked(outcome)),
        F.array_distinct(enrichment_evidence(F.col("_excerpts"), F.col("reviewer_notes"))),
    )


def authority_summary(evidence: Column) -> Column:
    """Strongest tier and the counts per tier, explicitness and review state."""

    def count(test) -> Column:
        return F.size(F.filter(evidence, test))

    tiers = string_array(AUTHORITY_TIERS)
    best = F.array_min(F.transform(evidence, lambda e: F.array_position(tiers, e.tier)))
    return F.struct(
        F.coalesce(F.get(tiers, (best - 1).cast("int")), F.lit("derived")).alias("strongest"),
        count(lambda e: e.tier == "primary-direct").alias("primary_direct"),
        count(lambda e: e.tier == "primary-indirect").alias("primary_indirect"),
        count(lambda e: e.tier == "secondary").alias("secondary"),
        count(lambda e: e.tier == "manual-curation").alias("manual_curation"),
        count(lambda e: e.reviewed).alias("reviewed"),
        count(lambda e: e.explicitness == "direct").alias("direct"),
        count(lambda e: e.explicitness == "indirect").alias("indirect"),
        count(lambda e: ~e.explicitness.isin("direct", "indirect")).alias("inferred"),
    )


def extraction_confidence() -> Column:
    """Hundredths added up as integers, capped at 0.95."""

    def flag(cond: Column, points: int) -> Column:
        return F.when(cond, points).otherwise(0)

    phases = F.array_except(
        F.array_distinct(F.transform("steps", lambda s: s.phase)), string_array(SPARSE_IGNORED_PHASES)
    )
    explicit = F.size(
        F.filter(
            "steps",
            lambda s: (s.phase != "unknown")
            & ((F.size(s.chemicals) > 0) | (F.size(s.concentrations) > 0) | (F.size(s.temperatures) > 0)),
        )
    )
    signals = [
        F.col("family") != "unknown",
        F.size("specimens") > 0,
        F.size("species") > 0,
        F.size("chemical_mentions") > 0,
        F.size("outcome_mentions") > 0,
        F.size("steps") > 0,
    ]
    points = F.lit(42)
    for signal in signals:
        points = points + flag(signal, 7)
    points = (
        points
        + flag(F.col("paper_type") == "experimental", 8)
        + flag(F.size(phases) >= 2, 7)
        + flag(F.size(phases) >= 3, 4)
        + flag(explicit >= 2, 5)
    )
    return F.least(points, F.lit(95)) / F.lit(100.0)


def assemble_extraction(papers: DataFrame, registry: Registry, evidence: bool = True) -> DataFrame:
    """Papers in, one extraction row per paper out, without a shuffle.

    ``papers`` needs domain, paper_id, title and abstract; curated records may be
    attached first with ``attach_reviewed_enrichment``. Flat label arrays
    (``chemicals``, ``outcomes``, ``phases``) sit beside the nested mentions so
    later jobs can read only what they need.
    """
    domain, title, facts = F.col("domain"), F.col("title"), F.col("facts")
    abstract = F.col("abstract")
    out = sentence_facts(augment_source_text(papers, registry), registry)
    # few wide projections: each one is analysed once, and later ones read columns
    out = out.withColumns(
        {
            "_family": protocol_family(title, abstract, registry),
            "paper_type": paper_type(title, abstract, registry, domain),
            "_species": _species_rules(registry, title),
            "_specimens": registry.by_domain(domain, lambda d: _specimen_rules(d, title)),
            "chemical_mentions": extract_chemicals(
                registry.by_domain(domain, lambda d: string_array([c.name for c in registry.chemicals(d)])), facts
            ),
            "outcome_mentions": extract_outcomes(registry.by_domain(domain, _outcome_rules), facts),
            "steps": extract_steps(facts),
            "temperatures": extract_mentions(facts, "temperatures"),
            "durations": extract_mentions(facts, "durations"),
        }
    )
    later = {
        "species": detect_species(F.col("_species"), facts),
        "specimens": rank_specimens(F.col("_specimens"), facts),
        "family": F.col("_family.family"),
        "chemicals": F.transform("chemical_mentions", lambda c: c["name"]),
        "outcomes": F.array_distinct(F.transform("outcome_mentions", lambda o: o.outcome_class)),
        "phases": F.transform("steps", lambda s: s.phase),
    }
    if evidence:
        later["evidence"] = collect_evidence(F.col("_specimens"), F.col("_species"))
    out = out.withColumns(later)
    last = {"confidence": extraction_confidence()}
    if evidence:
        last["authority"] = authority_summary(F.col("evidence"))
    out = out.withColumns(last)
    return out.drop("_family", "_species", "_specimens", "_sentences", "_excerpts", "facts")
