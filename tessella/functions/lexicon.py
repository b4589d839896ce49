"""Include and exclude lexicons. Word boundaries are spelt out, so that all engines agree on letters beyond ASCII."""

from pyspark.sql import Column
from pyspark.sql import functions as F

_S = r"[\s\p{Z}]"
_IN, _OUT = r"(?:^|[^\p{L}\p{N}_])", r"(?:$|[^\p{L}\p{N}_])"
#: A number after a mark that is a word of its own: white space, an equals sign or both stand between them.
_NUMBER = rf"(?:{_S}+=?|=){_S}*[0-9]"
#: Marks of risk and association studies.
INCLUDE = [
    "risk factors?", "relative risk", "risk ratio", "rate ratio", rf"{_IN}rr{_NUMBER}", "odds ratio", rf"{_IN}or{_NUMBER}", rf"p(?:-|{_S})?value", "associat", "confidence interval",
    rf"95%?{_S}*ci", rf"ci{_S}*95", rf"case(?:-|{_S})?control", "cohort study", "prevalence ratio", rf"{_IN}pr{_NUMBER}", rf"cross(?:-|{_S})?sectional",
]
#: Species other than cattle, and terms of human medicine; each a whole word.
EXCLUDE = [
    "(?:donkey|mule|horse|equine|camel|camelid|llama|alpaca)s?", "(?:whale|dolphin|porpoise)s?", "seals?", rf"sea{_S}+lions?", "walrus(?:es)?", "(?:poultry|chicken|broiler|hen|turkey|duck)s?", "(?:goose|geese)",
    "(?:badger|deer|elk|moose|caribou|antelope|boar)", "(?:murine|fox|bat|primate|monkey)s?", "(?:infant|toddler|adolescent)s?", "elderly", "icu", "breastfeeding", "diabetes", "dvt", r"menopaus[\p{L}\p{N}_]*", "malaria", "woman", "women",
]


def include_pattern(terms: list[str] | None = None) -> str:
    return "(?i)" + "|".join(f"(?:{t})" for t in terms or INCLUDE)


def exclude_pattern(terms: list[str] | None = None) -> str:
    return f"(?i){_IN}(?:{'|'.join(terms or EXCLUDE)}){_OUT}"


def flags(text: Column, include: list[str] | None = None, exclude: list[str] | None = None) -> tuple[Column, Column]:
    """Whether ``text`` has an included and an excluded term; null has neither."""
    has = lambda p: F.coalesce(text.rlike(p), F.lit(False))
    return has(include_pattern(include)), has(exclude_pattern(exclude))
