"""Word lists, rules and texts that results depend on.

Fixed values: they have to be these for right results.
"""

FUNCTION_WORDS = (
    "el la los las un una unos unas de del al a en con por para que y o pero sino porque cuando como "
    "se me te le nos les lo este esta estos estas ese esa esos esas mi tu su nuestro nuestra sus mis tus "
    "muy más menos también ya no sí"
).split()

ENSEMBLE_STOP_WORDS = "el la los las un una de a en con por para que y o pero se".split()

VERB_FORMS = (
    "fui fue fuiste fueron fuimos",
    "tengo tienes tiene tenemos tienen",
    "estoy estás está estamos están",
    "hablo hablas habla hablamos hablan",
    "comí comiste comió comimos comieron",
)

CATEGORIES = "ZERO ONE TWO THREE FOUR FIVE SIX".split()

DISFLUENCIES = (
    r"\b(?:um+|uh+|eh+|ah+|mm+)\b",
    r"\b(?:este|bueno|o sea|pues|a ver)\b",
    r"\b(?:como se dice|espera|no sé)\b",
    r"\.{2,}",
    r"\[.*?\]",
    r"\(.*?\)",
)

#: Applied in this order. Rules that change nothing in lower-case text are part of the list.
SUBSTITUTIONS = (
    (r"\bsalio\b", "salió"),
    (r"\bcomio\b", "comió"),
    (r"\bvino\b(?! a)", "vino"),
    (r"\bque\b(?= \w+ \w+ que)", "que"),
    (r"\baber\b", "haber"),
    (r"\balla\b", "allá"),
    (r"\besta\b(?= [a-z])", "está"),
    (r"\bgraned\b", "grande"),
    ("\\bciud\u0430\u0442\\b", "ciudad"),
)

MAJOR_DELETION = "Major deletion: >50% of words missing"
MAJOR_INSERTION = "Major insertion: >50% more words than target"
EMPTY_REASON = "Empty hypothesis — no response produced."
MANIFEST_TEXT = "[ADD REFERENCE TEXT HERE]"
#: Overlaps at which a score changes; confidence is the distance to the nearest.
OVERLAP_STEPS = (0.40, 0.60, 0.70, 0.80, 0.95)
#: Score, least token overlap, largest penalty; the first that holds.
LADDER = ((6, 0.95, 0), (5, 0.80, 1), (4, 0.70, 2), (3, 0.60, 4), (2, 0.40, None))
