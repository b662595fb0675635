"""The three shipped domains and the rules they share."""

from __future__ import annotations

from .model import (
    Alias,
    Concept,
    DomainProfile,
    Group,
    OutcomeRule,
    PhaseRule,
    Pick,
    Registry,
    SharedRules,
    Specimen,
    Template,
)

# Vocabularies every consumer must agree on.
SOURCES = ("cryodb", "pubmed", "openalex", "crossref", "europe-pmc", "semantic-scholar", "manual", "other")
DIVERSITY_SOURCES = ("cryodb", "pubmed", "openalex", "crossref", "europe-pmc", "semantic-scholar")
CORPUS_SOURCE = "cryodb"
AVAILABILITY = ("unknown", "abstract-only", "full-text-link", "open-access-full-text")
FAMILIES = ("vitrification", "slow-freezing", "comparative", "unknown")
PAPER_TYPES = ("experimental", "review", "methods", "commentary", "unknown")
OUTCOME_CLASSES = ("morphology", "viability", "function", "reproductive", "transplantation")
STRENGTHS = ("weak", "moderate", "strong")
DECISIONS = ("pending", "promote", "defer", "reject")
RECOMMENDATIONS = ("promote", "review", "defer")
ENRICHMENT_PRIORITIES = ("extractor-gap", "ambiguous-evidence", "evidence-thin", "step-phase-manual")
ENRICHMENT_STATUSES = ("pending", "in-progress", "reviewed", "llm-triaged", "rejected")
#: The order in which a queue lists them.
ENRICHMENT_STATUS_RANK = ("in-progress", "pending", "llm-triaged", "reviewed", "rejected")
AUTHORITY_TIERS = ("primary-direct", "primary-indirect", "manual-curation", "secondary", "derived")
BASE_CHEMICALS = ("Dimethyl Sulfoxide", "Ethylene Glycol", "Glycerol", "Propylene Glycol", "Sucrose")
SPARSE_IGNORED_PHASES = ("unknown", "assessment", "culture")
# Workflow rank per phase; phases not listed rank last.
PHASE_RANK = {
    "equilibration": 1,
    "loading": 2,
    "perfusion": 2,
    "cooling": 3,
    "storage": 4,
    "warming": 5,
    "unloading": 5,
    "culture": 6,
    "assessment": 7,
    "unknown": 99,
}
BACKBONE_PHASES = (
    "equilibration", "loading", "cooling", "storage", "warming", "unloading", "perfusion", "culture",
)
CONDITION_PHASES = ("equilibration", "loading", "cooling", "warming", "unloading", "perfusion")
PROCEDURE_PHASES = ("equilibration", "loading", "cooling", "storage", "warming", "unloading", "perfusion")

# Dictionaries and patterns shared by all domains.
SHARED = SharedRules(
    chemicals=(
        Alias("Dimethyl Sulfoxide", ("dmso", "me2so", "dimethyl sulfoxide", "dimethyl sulphoxide")),
        Alias("Ethylene Glycol", ("eg", "ethylene glycol")),
        Alias("Propylene Glycol", ("proh", "propylene glycol", "1,2-propanediol", "1,2 propanediol")),
        Alias("Glycerol", ("glycerol",)),
        Alias("Sucrose", ("sucrose",)),
        Alias("Trehalose", ("trehalose",)),
        Alias("Curcumin", ("curcumin",)),
        Alias("Beraprost Sodium", ("beraprost sodium", "beraprost")),
        Alias("Hydroxyethyl Starch", ("hydroxyethyl starch", "hes")),
        Alias("Polyvinyl Pyrrolidone", ("polyvinyl pyrrolidone", "polyvinylpyrrolidone", "pvp")),
        Alias("Polyethylene Glycol", ("polyethylene glycol", "peg")),
        Alias(
            "Carboxylated epsilon-poly-L-lysine",
            ("carboxylated ε-poly-l-lysine", "carboxylated e-poly-l-lysine", "epsilon-poly-l-lysine"),
        ),
        Alias("Alginate", ("alginate",)),
        Alias("Ficoll", ("ficoll",)),
        Alias("Raffinose", ("raffinose",)),
    ),
    species=(
        ("human", r"(?i)\bhuman\b"),
        ("mouse", r"(?i)\bmouse\b|\bmurine\b"),
        ("rat", r"(?i)\brat\b"),
        ("sheep", r"(?i)\bsheep\b|\bovine\b"),
        ("pig", r"(?i)\bpig\b|\bporcine\b"),
        ("dog", r"(?i)\bdog\b|\bcanine\b"),
        ("cat", r"(?i)\bcat\b|\bfeline\b"),
        ("goat", r"(?i)\bgoat\b|\bcaprine\b"),
        ("turkey", r"(?i)\bturkey\b"),
        ("peccary", r"(?i)\bpeccary\b"),
        ("primate", r"(?i)\bprimate\b|\bmonkey\b"),
    ),
    phases=(
        PhaseRule("perfusion", (r"(?i)\bperfus",)),
        PhaseRule("equilibration", (r"(?i)\bequilibr", r"(?i)\bstepwise equilibration\b")),
        PhaseRule(
            "loading",
            (
                r"(?i)\bloading\b",
                r"(?i)\bcryoprotectant(?:s)? added\b",
                r"(?i)\badded at \d+(?:\.\d+)?%",
                r"(?i)\bpreincubat",
            ),
        ),
        PhaseRule(
            "cooling",
            (r"(?i)\bcool", r"(?i)\bfreez", r"(?i)\bcooling rate\b", r"(?i)\b0\.\d+\s?°?\s?c/min\b"),
        ),
        PhaseRule("storage", (r"(?i)\bstor", r"(?i)\bliquid nitrogen", r"(?i)\b-196\s?°?\s?c\b")),
        PhaseRule("warming", (r"(?i)\bwarm", r"(?i)\bthaw", r"(?i)\brewarm")),
        PhaseRule("culture", (r"(?i)\bculture", r"(?i)\bincubat")),
        PhaseRule("assessment", (r"(?i)\bassess", r"(?i)\bmorpholog", r"(?i)\bviability", r"(?i)\bfunction")),
    ),
    required_concepts=(
        Concept("cryopreservation", ("cryopreservation", "cryopreserved")),
        Concept("vitrification", ("vitrification", "vitrified")),
        Concept("freezing", ("freezing", "frozen", "slow freezing", "slow cooling")),
        Concept("thaw", ("thaw", "thawed", "post-thaw")),
        Concept(
            "cryoprotectant",
            ("cryoprotectant", "cryoprotective", "dmso", "dimethyl sulfoxide", "ethylene glycol"),
        ),
    ),
    temperature=r"(?i)-?\d+(?:\.\d+)?\s?(?:°\s?)?C\b",
    duration=r"(?i)\b\d+(?:\.\d+)?\s?(?:min|mins|minutes|h|hr|hrs|hours|day|days|week|weeks|month|months)\b",
    concentration=r"\b\d+(?:\.\d+)?\s?(?:M|mM|%|mol/L)\b",
    rate=r"(?i)\b\d+(?:\.\d+)?\s?°?\s?C\s*/\s*(?:min|hour|hr|h)\b",
    review_patterns=(
        r"\breview\b|\bmini-review\b|\bperspective\b|\bprospects?\b|\bthis review\b|\brecent advances\b",
    ),
    methods_patterns=(
        r"\bprotocol\b|\boptimization\b|\bthermophysical\b|\bcharacterization\b|\bcharacterisation\b",
    ),
    commentary_patterns=(r"\bcommentary\b|\beditorial\b",),
    experimental_patterns=(
        r"(?i)\bthis study\b|\bwe evaluated\b|\bwe used\b|\bwere compared\b|\bafter thaw\b"
        r"|\bafter warming\b|\bafter transplantation\b",
    ),
    study_terms=(
        r"(?i)(?:result|found|observed|showed|demonstrated|improved|restored|viability|survival|recovery|yield"
        r"|toxicit|function|functional|functionality|morpholog|histolog|ultrastruct)"
    ),
    preserving_terms=(
        r"(?i)\benhances?\b|\bpreserves?\b|\bpreservation\b|\bsurvival\b|\brecovery\b|\bfunction\b"
    ),
    process_context=(
        r"(?i)(?:cryopreserv|vitrif|slow freezing|slow cool(?:ing|ed)?|cool(?:ing|ed)?|freez(?:ing|e|en)?"
        r"|warm(?:ing|ed)?|thaw(?:ing|ed)?|rewarm|stor(?:age|ed)?|liquid nitrogen|perfus|culture"
        r"|cryoprotectant|equilibrat|loaded?)"
    ),
    stepwise=r"(?i)\bstepwise\b|\bsequential",
    vitrification=r"(?i)\bvitrif",
    slow_freezing=r"(?i)\bslow freezing\b|\bslow cooling\b",
)

# Wording and titles that several domains share.
_STRUCTURE_OUTCOMES = (
    r"(?i)\bmorpholog(?:y|ical)\b", r"(?i)\bhistolog(?:y|ical)\b", r"(?i)\bultrastruct(?:ure|ural)\b",
)
_REVIEW_TITLES = Concept("review style", ("systematic review", "meta-analysis", "meta analysis"))
_SUMMARY_TITLES = Concept("broad summary", ("overview", "state of the art"))


# The hypotheses, their categories and groups.
def _family_templates(
    subject: str, specimens: tuple[str, ...], slow: int, vitrified: int, adjunct: str, adjuncts: int,
    adjunct_title: str, resolution: str, bulk: str, bulk_title: str, confidences: tuple[float, ...],
) -> tuple[Template, ...]:
    """The five hypotheses both cell-suspension domains ask, with their own thresholds."""
    experimental = {"experimental": True}
    benchmark = Template(
        title=f"Matched-species {subject} vitrification vs slow-freezing benchmark",
        category="benchmark",
        confidence=confidences[0],
        groups=(
            ("slow", Group(family="slow-freezing", **experimental)),
            ("vitrified", Group(family="vitrification", **experimental)),
            ("compared", Group(family="comparative", **experimental)),
        ),
        rule=f"slow >= {slow} and (vitrified >= {vitrified} or compared >= 1)",
        chemicals=Pick(groups=("slow", "vitrified"), limit=5),
        specimens=Pick(fixed=specimens),
        families=Pick(groups=("slow", "vitrified", "compared")),
        titles=Pick(groups=("compared", "vitrified", "slow"), limit=6),
    )

    def one_group(title: str, category: str, confidence: float, group: Group, rule: str, chemicals: int = 5,
                  more: tuple[tuple[str, Group], ...] = ()) -> Template:
        return Template(
            title=title,
            category=category,
            confidence=confidence,
            groups=(("chosen", group), *more),
            rule=rule,
            chemicals=Pick(groups=("chosen",), limit=chemicals),
            specimens=Pick(fixed=specimens),
            families=Pick(groups=("chosen",)),
            titles=Pick(groups=("chosen",), limit=6),
        )

    return (
        benchmark,
        one_group(adjunct_title, "benchmark", confidences[1], Group(title=adjunct, **experimental),
                  f"chosen >= {adjuncts}", chemicals=6),
        one_group(f"Promote {subject} function-heavy protocols to transplantation endpoints", "endpoint-upgrade",
                  confidences[2], Group(outcomes=("function",), **experimental), "chosen > transplanted",
                  more=(("transplanted", Group(outcomes=("transplantation",), **experimental)),)),
        one_group(resolution, "workflow-gap", confidences[3], Group(sparse=True, **experimental), "chosen >= 2"),
        one_group(bulk_title, "scale-up", confidences[4], Group(title=bulk, **experimental), "chosen >= 2"),
    )


# The islets domain.
ISLETS = DomainProfile(
    id="islets",
    label="Islets",
    ingest_anchors=(
        "islet", "islets", "pancreatic islet", "pancreatic islets", "islet cell", "islet cells",
        "islet transplantation", "islet graft", "encapsulated islets",
    ),
    ingest_supporting=(
        "pancreatic", "beta cell", "beta cells", "insulin", "glucose", "diabetes", "transplantation",
        "cryopreservation", "vitrification", "slow freezing",
    ),
    anchors=(
        Concept("pancreatic islets", ("pancreatic islets", "pancreatic islet")),
        Concept("islets", ("islets", "islet")),
        Concept("encapsulated islets", ("encapsulated islets", "encapsulated islet")),
    ),
    extra_required=(
        Concept("recovery", ("recovery", "viability", "post-thaw recovery")),
        Concept("freezer bag", ("freezer bag",)),
    ),
    context=(
        Concept("transplantation", ("transplantation", "transplant")),
        Concept("graft", ("graft", "grafts")),
        Concept("insulin", ("insulin",)),
        Concept("beta cell", ("beta cell", "beta cells")),
    ),
    text_prefix="Islet source context",
    specimens=(
        Specimen("pancreatic islets", r"(?i)\bpancreatic islets?\b", 3.0),
        Specimen("islets", r"(?i)\bislets?\b", 3.0),
        Specimen("islet cells", r"(?i)\bislet cells?\b", 2.0),
        Specimen("encapsulated islets", r"(?i)\bencapsulat(?:ed|ion)(?:\s+\w+){0,2}\s+islets?\b", 3.0),
        Specimen("islet grafts", r"(?i)\bislet grafts?\b", 2.0),
        Specimen("beta cells", r"(?i)\bbeta cells?\b", 1.0),
    ),
    outcomes=(
        OutcomeRule(
            "transplantation",
            "strong",
            (
                r"(?i)\btransplant(?:ation|ed)?\b", r"(?i)\bauto-?transplant(?:ation|ed)?\b",
                r"(?i)\bxeno-?graft(?:ed|s)?\b", r"(?i)\bauto-?graft(?:ed|s)?\b", r"(?i)\bgraft(?:ed|s)?\b",
            ),
        ),
        OutcomeRule(
            "function",
            "strong",
            (
                r"(?i)\bfunction(?:al|ality)?\b", r"(?i)\binsulin secretion\b", r"(?i)\binsulin release\b",
                r"(?i)\bgraft function\b", r"(?i)\bglucose(?:-|\s)?stimulated\b", r"(?i)\bglucose control\b",
                r"(?i)\bnormoglyc", r"(?i)\beuglyc",
            ),
        ),
        OutcomeRule(
            "viability",
            "moderate",
            (
                r"(?i)\bviability\b", r"(?i)\blive-dead assay\b", r"(?i)\bcell survival\b", r"(?i)\bsurvival\b",
                r"(?i)\brecovery\b", r"(?i)\byield\b", r"(?i)\btoxicit",
            ),
        ),
        OutcomeRule("morphology", "moderate", _STRUCTURE_OUTCOMES),
    ),
    outcome_terms=r"(?i)insulin|glucose|graft|transplant",
    assessment=(r"(?i)\binsulin secretion",),
    experimental_rules=(
        (
            r"(?i)\bcryopreserv",
            r"(?i)\bislet",
            r"(?i)\bcomparison\b|\btechnique\b|\bsurvival\b|\brecovery\b|\bfunction\b|\byield\b|\bstorage\b|\btransplant"
            r"|\bmouse\b|\brat\b|\bporcine\b|\bpig\b|\bcanine\b|\bhuman\b",
        ),
        (
            r"(?i)\bcryogenic\b|\bfreez(?:ing)?\b|\bfrozen-thawed\b|\bthaw(?:ing)?\b",
            r"(?i)\bislet",
            r"(?i)\bporcine\b|\bpig\b|\brat\b|\bmouse\b|\bcanine\b|\bhuman\b|\bchick\b",
        ),
    ),
    templates=_family_templates(
        "islet", ("islets", "pancreatic islets"), 8, 2,
        r"(?i)trehalose|curcumin|beraprost|p38 mapk inhibitor|polyvinyl pyrrolidone|polyethylene glycol", 4,
        "Additive-assisted islet recovery benchmark on a fixed base cryomix",
        "Full-text protocol resolution for sparse islet thaw/loading workflows",
        r"(?i)banking|large quantities|bulk|transported between centers",
        "Scale-up benchmark for banked or bulk islet handling",
        (0.86, 0.83, 0.81, 0.84, 0.78),
    ),
    generic_specimens=("islets", "pancreatic islets"),
    preferred_title=r"(?i)additive-assisted",
    benchmark_needs_both_families=True,
    commercial_bonus=0.08,
)

# The ovarian-tissue domain.
OVARIAN_TISSUE = DomainProfile(
    id="ovarian-tissue",
    label="Ovarian tissue",
    ingest_anchors=(
        "ovary", "ovaries", "ovarian tissue", "ovarian cortex", "ovarian cortical", "cortical pieces",
        "cortical strips", "whole ovary", "follicle", "follicles",
    ),
    ingest_supporting=(
        "ovarian", "oocyte", "oocytes", "fertility preservation", "reproductive tissue", "cryopreservation",
    ),
    anchors=(
        Concept("ovarian tissue", ("ovarian tissue", "ovarian tissues")),
        Concept("ovarian cortex", ("ovarian cortex", "ovarian cortical")),
        Concept("whole ovary", ("whole ovary", "whole ovaries")),
        Concept(
            "follicles",
            (
                "ovarian follicle", "ovarian follicles", "primordial follicle", "primordial follicles",
                "preantral follicle", "preantral follicles",
            ),
        ),
    ),
    extra_required=(Concept("cryostorage", ("cryostorage", "liquid nitrogen")),),
    context=(
        Concept("fertility preservation", ("fertility preservation",)),
        Concept("oocyte", ("oocyte", "oocytes")),
        Concept("transplantation", ("transplantation", "transplant", "autotransplant", "graft")),
    ),
    title_methods=(
        Concept("protocol", ("protocol", "procedure", "workflow", "method")),
        Concept("comparison", ("comparison", "compare", "versus", "vs")),
        Concept("culture", ("culture", "cultured", "in vitro growth", "ivg")),
        Concept(
            "cryoprotectant handling",
            (
                "cryoprotectant", "cryoprotective agent", "cryoprotective agents", "permeation",
                "equilibration", "warming",
            ),
        ),
        Concept("freezing method", ("slow freezing", "slow cooling", "vitrification", "vitrified")),
    ),
    blocked=(
        _REVIEW_TITLES,
        Concept(
            "clinical outcome",
            ("live birth", "pregnancy", "pregnancies", "woman", "women", "children following"),
        ),
        _SUMMARY_TITLES,
    ),
    min_title_required=2,
    min_title_methods=1,
    text_prefix="Ovarian source context",
    extra_chemicals=(Alias("Ringer-Acetate", ("ringer-acetate", "ringer acetate")),),
    specimens=(
        Specimen("whole ovary", r"(?i)\bwhole ovary\b", 3.0),
        Specimen("ovarian tissue", r"(?i)\bovarian tissue\b", 3.0),
        Specimen("ovarian cortex", r"(?i)\bovarian cortical?(?: pieces?| strips?| blocks?)?\b", 3.0),
        Specimen("follicles", r"(?i)\bfollicles?\b", 2.0),
        Specimen("oocytes", r"(?i)\boocytes?\b", 1.0),
        Specimen("embryos", r"(?i)\bembryos?\b", 1.0),
    ),
    outcomes=(
        OutcomeRule(
            "reproductive",
            "strong",
            (r"(?i)\blive births?\b", r"(?i)\bpregnancy\b", r"(?i)\bfertilizable oocytes?\b"),
        ),
        OutcomeRule(
            "transplantation",
            "strong",
            (
                r"(?i)\btransplant(?:ation|ed)?\b", r"(?i)\bauto-?transplantation\b",
                r"(?i)\borthotopic(?:ally)?\b",
            ),
        ),
        OutcomeRule(
            "function",
            "moderate",
            (
                r"(?i)\bhormone function\b", r"(?i)\bhormones? (?:were )?restored\b",
                r"(?i)\bcyclic ovarian activity\b",
            ),
        ),
        OutcomeRule(
            "viability",
            "moderate",
            (r"(?i)\bviability\b", r"(?i)\blive-dead assay\b", r"(?i)\bmortality rates?\b"),
        ),
        OutcomeRule(
            "morphology",
            "weak",
            (
                r"(?i)\bmorpholog(?:y|ical)\b", r"(?i)\bultrastruct(?:ure|ural)\b",
                r"(?i)\bhistolog(?:y|ical)\b",
            ),
        ),
    ),
    outcome_terms=r"(?i)pregnancy|live births?|hormone|follicle|oocyte",
    extra_review=(
        r"\bfuture potential\b", r"\bthis paper selectively reviews\b", r"\bthis review summarizes\b",
    ),
    extra_methods=(r"\bdifferential scanning calorimetry\b",),
    extra_experimental=(r"(?i)\bresult\(s\)\b", r"(?i)\bmethods\b"),
    templates=(
        Template(
            title="Head-to-head DMSO-centered ovarian tissue benchmark",
            category="benchmark",
            confidence=0.84,
            groups=(("chosen", Group(specimen="ovarian tissue", chemicals=("Dimethyl Sulfoxide",))),),
            rule="chosen >= 4",
            chemicals=Pick(fixed=("Dimethyl Sulfoxide",)),
            specimens=Pick(fixed=("ovarian tissue",)),
            families=Pick(groups=("chosen",), drop=("unknown",)),
            titles=Pick(groups=("chosen",), limit=6),
        ),
        Template(
            title="Same-species DMSO + EG vitrification benchmark",
            category="benchmark",
            confidence=0.79,
            groups=(
                (
                    "chosen",
                    Group(specimen="ovarian tissue", chemicals=("Dimethyl Sulfoxide", "Ethylene Glycol")),
                ),
            ),
            rule="chosen >= 2",
            chemicals=Pick(fixed=("Dimethyl Sulfoxide", "Ethylene Glycol")),
            specimens=Pick(fixed=("ovarian tissue", "follicles")),
            families=Pick(groups=("chosen",)),
            titles=Pick(groups=("chosen",)),
        ),
        Template(
            title="Promote morphology-heavy protocols to viability endpoints",
            category="endpoint-upgrade",
            confidence=0.82,
            groups=(
                ("chosen", Group(specimen="ovarian tissue", outcomes=("morphology",))),
                (
                    "stronger",
                    Group(
                        specimen="ovarian tissue",
                        outcomes=("viability", "reproductive", "transplantation", "function"),
                    ),
                ),
            ),
            rule="chosen > stronger",
            chemicals=Pick(groups=("chosen",), limit=4),
            specimens=Pick(fixed=("ovarian tissue", "follicles")),
            families=Pick(groups=("chosen",)),
            titles=Pick(groups=("chosen",), limit=6),
        ),
        Template(
            title="Whole-ovary perfusion and rewarming workflow benchmark",
            category="scale-up",
            confidence=0.76,
            groups=(
                ("chosen", Group(specimen="whole ovary")),
                ("perfused", Group(specimen="whole ovary", phase="perfusion")),
            ),
            rule="chosen between 1 and 4",
            chemicals=Pick(groups=("chosen",)),
            specimens=Pick(fixed=("whole ovary",)),
            families=Pick(groups=("chosen",)),
            titles=Pick(groups=("perfused",)),
        ),
        Template(
            title="Manual full-text resolution of unknown experimental protocols",
            category="workflow-gap",
            confidence=0.87,
            groups=(("chosen", Group(experimental=True, family="unknown")),),
            rule="chosen >= 3",
            chemicals=Pick(groups=("chosen",), limit=5),
            specimens=Pick(groups=("chosen",), limit=5),
            families=Pick(fixed=("unknown",)),
            titles=Pick(groups=("chosen",), limit=6),
        ),
    ),
    generic_specimens=("ovarian tissue", "follicles"),
    resolution_bonus=(("ovarian tissue", 2.0), ("whole ovary", 1.0)),
)

# The hepatocytes domain.
HEPATOCYTES = DomainProfile(
    id="hepatocytes",
    label="Hepatocytes",
    ingest_anchors=(
        "hepatocyte", "hepatocytes", "primary hepatocytes", "human hepatocytes", "liver cells", "liver cell",
    ),
    ingest_supporting=(
        "liver", "hepatic", "albumin", "urea", "cytochrome", "cyp", "drug metabolism", "attachment", "plating",
        "transplantation", "cell therapy", "cryopreservation", "vitrification", "slow freezing",
    ),
    anchors=(
        Concept("hepatocytes", ("hepatocytes", "hepatocyte")),
        Concept(
            "primary hepatocytes",
            ("primary hepatocytes", "primary hepatocyte", "primary human hepatocytes"),
        ),
        Concept("human hepatocytes", ("human hepatocytes", "human hepatocyte")),
        Concept("liver cells", ("liver cells", "liver cell")),
    ),
    extra_required=(
        Concept("viability", ("viability", "viable", "recovery", "post-thaw recovery")),
        Concept("attachment", ("attachment", "plating", "plateable", "adherence", "adhesion")),
    ),
    context=(
        Concept("transplantation", ("transplantation", "transplant", "engraftment")),
        Concept("cell therapy", ("cell therapy", "cell-based therapy", "bioartificial liver")),
        Concept("drug metabolism", ("drug metabolism", "xenobiotic", "metabolic competence")),
        Concept("albumin", ("albumin",)),
        Concept("urea", ("urea", "ureagenesis")),
        Concept("CYP", ("cyp", "cytochrome p450", "cyp3a4", "cyp1a2", "cyp2c9")),
    ),
    blocked=(
        _REVIEW_TITLES,
        Concept(
            "whole-organ transplantation",
            (
                "liver transplantation", "liver transplant", "liver graft", "liver allograft", "donor liver",
                "liver donor", "hepatectomy",
            ),
        ),
        _SUMMARY_TITLES,
    ),
    text_prefix="Hepatocyte source context",
    extra_chemicals=(
        Alias(
            "University of Wisconsin Solution",
            ("university of wisconsin solution", "uw solution", "viaspan"),
        ),
        Alias("Fetal Bovine Serum", ("fetal bovine serum", "fetal calf serum", "fbs", "fcs")),
        Alias("ROCK Inhibitor", ("rock inhibitor", "y-27632", "y27632")),
        Alias("CryoStor", ("cryostor", "cryostor cs10", "cs10")),
        Alias("HypoThermosol", ("hypothermosol",)),
        Alias("Sericin", ("sericin",)),
    ),
    specimens=(
        Specimen("primary hepatocytes", r"(?i)\bprimary (?:human |rat |mouse |porcine |pig )?hepatocytes?\b", 3.0),
        Specimen("hepatocytes", r"(?i)\bhepatocytes?\b", 3.0),
        Specimen("human hepatocytes", r"(?i)\bhuman hepatocytes?\b", 2.0),
        Specimen("liver cells", r"(?i)\bliver cells?\b", 2.0),
        Specimen("hepatocyte spheroids", r"(?i)\bhepatocyte spheroids?\b|\bliver spheroids?\b", 2.0),
        Specimen("hepatocyte-like cells", r"(?i)\bhepatocyte-like cells?\b", 2.0),
        Specimen("liver tissue", r"(?i)\bliver (?:tissue|slices?)\b", 1.0),
    ),
    outcomes=(
        OutcomeRule(
            "transplantation",
            "strong",
            (
                r"(?i)\btransplant(?:ation|ed)?\b", r"(?i)\bengraft(?:ment|ed)?\b", r"(?i)\bgraft(?:ed|s)?\b",
                r"(?i)\brepopulat(?:ion|ed)\b",
            ),
        ),
        OutcomeRule(
            "function",
            "strong",
            (
                r"(?i)\bfunction(?:al|ality)?\b", r"(?i)\balbumin (?:secretion|production|synthesis)\b",
                r"(?i)\burea (?:synthesis|production)\b", r"(?i)\bcyp\d[a-z]*\d*\b",
                r"(?i)\bcytochrome p450\b", r"(?i)\bdrug metabolism\b",
                r"(?i)\bmetabolic (?:activity|competence|capacity)\b",
                r"(?i)\bammonia (?:clearance|detoxification)\b",
            ),
        ),
        OutcomeRule(
            "viability",
            "moderate",
            (
                r"(?i)\bviability\b", r"(?i)\blive-dead assay\b", r"(?i)\bcell survival\b", r"(?i)\bsurvival\b",
                r"(?i)\brecovery\b", r"(?i)\byield\b", r"(?i)\battachment\b", r"(?i)\bplating efficiency\b",
                r"(?i)\bplateab", r"(?i)\btoxicit",
            ),
        ),
        OutcomeRule("morphology", "moderate", _STRUCTURE_OUTCOMES),
    ),
    outcome_terms=(
        r"(?i)albumin|urea|cyp|cytochrome|attachment|plating|engraft|transplant|ammonia|metaboli"
    ),
    assessment=(r"(?i)\balbumin\b", r"(?i)\burea\b", r"(?i)\battachment\b"),
    experimental_rules=(
        (
            r"(?i)\bcryopreserv",
            r"(?i)\bhepatocyte|\bliver cell",
            r"(?i)\bcomparison\b|\btechnique\b|\bsurvival\b|\brecovery\b|\bfunction\b|\byield\b|\bstorage\b|\battachment\b|\btransplant"
            r"|\bmouse\b|\brat\b|\bporcine\b|\bpig\b|\bcanine\b|\bhuman\b",
        ),
        (
            r"(?i)\bcryogenic\b|\bfreez(?:ing)?\b|\bfrozen-thawed\b|\bthaw(?:ing)?\b",
            r"(?i)\bhepatocyte|\bliver cell",
            r"(?i)\bporcine\b|\bpig\b|\brat\b|\bmouse\b|\bcanine\b|\bhuman\b",
        ),
    ),
    templates=_family_templates(
        "hepatocyte", ("hepatocytes", "primary hepatocytes"), 5, 1,
        r"(?i)trehalose|glucose|hydroxyethyl starch|polyvinyl|pvp|polyethylene glycol|rock inhibitor|y-27632"
        r"|caspase|antioxidant|glutathione|n-acetylcysteine|melatonin|sericin|serum"
        r"|university of wisconsin|uw solution|cryostor|encapsulat|alginate", 3,
        "Additive-assisted hepatocyte attachment and function benchmark on a fixed base cryomix",
        "Full-text protocol resolution for sparse hepatocyte thaw/loading workflows",
        r"(?i)banking|\bbank\b|large quantities|bulk|large-scale|scale-up|batch",
        "Scale-up benchmark for banked or bulk hepatocyte handling",
        (0.8, 0.78, 0.76, 0.8, 0.72),
    ),
    generic_specimens=("hepatocytes", "primary hepatocytes"),
    resolution_bonus=(("primary hepatocytes", 2.0), ("human hepatocytes", 1.0)),
    benchmark_needs_both_families=True,
)


def default_registry() -> Registry:
    return Registry((ISLETS, OVARIAN_TISSUE, HEPATOCYTES), SHARED)
