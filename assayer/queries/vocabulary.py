"""How the invented words of the test documents are read as subject terms.

The driver's documents are invented prose. To run the shipped dictionaries over
them, frequent words of each language are replaced by terms of one domain.
"""

# Document language to domain.
DOMAIN_OF_LANG = {"en": "islets", "fr": "ovarian-tissue", "de": "hepatocytes", "es": "hepatocytes"}

# Invented word to subject term, per language.
TERMS = {
    "en": {
        "that": "islets", "was": "pancreatic islets", "it": "cryopreservation", "for": "freezing",
        "with": "vitrification", "be": "DMSO", "by": "trehalose", "this": "slow cooling", "are": "viability",
        "at": "recovery", "from": "2 M", "an": "warming", "re": "insulin secretion", "th": "-40 C",
        "st": "5 min", "nd": "10%", "ed": "human", "ou": "rat", "ha": "cooled", "he": "culture",
        "or": "0.25 C/min", "ti": "stored", "ea": "transplantation", "nt": "morphology", "ble": "review",
        "tion": "this study", "sh": "sucrose", "wh": "ethylene glycol", "ther": "protocol", "er": "loading",
        "thin": "1.5 mM", "erin": "30 min", "then": "equilibrated", "thed": "stepwise", "thon": "4 C",
        "than": "glycerol", "thor": "37 C", "thre": "encapsulated islets", "thha": "perfused",
        "thes": "curcumin", "thea": "yield", "eren": "mouse", "in": "improved", "on": "thaw",
    },
    "fr": {
        "le": "ovarian tissue", "et": "cryopreservation", "des": "follicles", "un": "vitrification",
        "les": "ovarian cortex", "en": "slow freezing", "une": "DMSO", "que": "viability", "dans": "1.5 M",
        "pour": "warming", "du": "ethylene glycol", "au": "morphology", "par": "-196 C", "sur": "10 min",
        "pas": "human", "qui": "bovine", "ou": "pregnancy", "on": "loading", "la": "comparison",
        "est": "whole ovary", "re": "protocol", "ai": "cooled", "de": "culture", "oi": "sucrose",
    },
    "de": {
        "der": "hepatocytes", "die": "cryopreservation", "und": "primary hepatocytes", "den": "DMSO",
        "von": "viability", "zu": "thaw", "das": "attachment", "mit": "slow freezing", "sich": "vitrification",
        "auf": "2 M", "im": "human", "ist": "-80 C", "dem": "albumin", "nicht": "24 h", "ein": "trehalose",
        "en": "cooled", "er": "function", "ch": "fetal bovine serum", "in": "warming", "ung": "survival",
    },
    "es": {
        "de": "hepatocytes", "la": "cryopreservation", "que": "liver cells", "el": "DMSO", "y": "recovery",
        "los": "thawed", "del": "freezing", "se": "vitrification", "las": "10%v", "por": "rat", "un": "-196 C",
        "no": "transplantation", "una": "48 hours", "con": "glucose", "su": "plating", "para": "storage",
        "en": "cooling", "es": "compared",
    },
}

# Which invented providers supply which identities and links.
DOI_SOURCES = tuple(f"src{i}" for i in (0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11))
PMID_SOURCES = tuple(f"src{i}" for i in (4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15))
PMCID_SOURCES = tuple(f"src{i}" for i in (8, 9, 10, 11))
OPEN_SOURCES = tuple(f"src{i}" for i in (0, 4, 8, 12, 16))
LINK_SOURCES = tuple(f"src{i}" for i in (1, 5, 9, 13, 17))
DIVERSITY_SOURCES = tuple(f"src{i}" for i in range(6))
