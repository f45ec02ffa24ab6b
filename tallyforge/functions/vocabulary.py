"""Word lists and lexicons of the text rules.  All of them are parameters; these are the defaults."""

from __future__ import annotations

from dataclasses import dataclass, field

#: Words that may not start or end a keyword.
STOPWORDS = (
    "a an and after any are at be been but by for from get i in is it my need of on or our so still that the this to what which with you your diesel truck part option "
    "more replies reply comments comment see view gallery share http https www com reddit org amp removed deleted edit as well if don doesn didn isn won wouldn t s ve re ll now right sure know make no"
).split()
#: Words no keyword may hold.
NOISE = "http https www com reddit org amp comments comment replies reply gallery share view more removed deleted edit as well if don doesn didn isn won wouldn t s ve re ll now right sure know make no miles".split()
#: Words of fragments of sentences.
FRAGMENTS = "just got get because im i m was were been being all over also can could would should have has had do does did not will still really thing things".split()
#: A keyword holds at least one of these.
ANCHORS = (
    "cummins duramax powerstroke ford diesel dpf egr ccv pcv downpipe tuner tuning exhaust egt temperature cooler valve pipe kit clamp regen leak failure failed broken crack clog fitment installation "
    "towing hauling commute winter off road work truck engine manifold intercooler gauge sensor injector turbo cooling system fuel oil filter delete"
).split()
#: Phrases that are no keywords.
PHRASES = ["diesel truck", "pickup truck", "diesel pickup"]
#: Patterns of what a record signals.
PAIN = r"\b(?:leak|leaked|seep|seeping|fail|failed|broken|crack|cracked|regen|clog|issue|problem)\b"
WORKAROUND = r"\b(?:fix|fixed|replace|replaced|install|installed|clamp|solution)\b"
PURCHASE = r"\b(?:buy|bought|purchase|price|cost|order|ordered|recommend|what should i)\b"
PROMOTION = r"\b(?:coupon|promo|affiliate|buy now|free shipping)\b"


@dataclass(frozen=True)
class Words:
    """What makes a run of words a keyword."""

    stop: tuple[str, ...] = tuple(STOPWORDS)
    noise: tuple[str, ...] = tuple(NOISE)
    fragments: tuple[str, ...] = tuple(FRAGMENTS)
    anchors: tuple[str, ...] = tuple(ANCHORS)
    phrases: tuple[str, ...] = tuple(PHRASES)

    def bad(self) -> str:
        """A pattern of n-grams that are no keywords."""
        inside = "|".join(dict.fromkeys([*self.noise, *self.fragments]))
        edge = "|".join(self.stop)
        return rf"^(?:{edge}) | (?:{edge})$|(?:^| )(?:{inside})(?: |$)|(?:^| )[0-9][0-9]+(?: |$)|^(?:{'|'.join(self.phrases)})$"

    def good(self) -> str:
        return rf"(?:^| )(?:{'|'.join(self.anchors)})(?: |$)"


@dataclass(frozen=True)
class Lexicon:
    """Vocabularies of a domain and what lies outside it."""

    platforms: tuple[str, ...] = ()
    products: tuple[str, ...] = ()
    vehicle_terms: tuple[str, ...] = ()
    scenarios: tuple[str, ...] = ()
    brands: tuple[str, ...] = ()
    slang: tuple[str, ...] = ()
    off_domain: tuple[str, ...] = ()
    excluded_communities: tuple[str, ...] = ()
    promotional: tuple[str, ...] = ()
    approved_communities: tuple[str, ...] = ()
    extra: dict[str, tuple[str, ...]] = field(default_factory=dict, compare=False)


def load_lexicon(path: str) -> Lexicon:
    """A lexicon from a YAML configuration with ``dictionaries``, ``exclusions`` and ``communities``."""
    import yaml

    with open(path, encoding="utf-8") as f:
        doc = yaml.safe_load(f) or {}
    words, out = doc.get("dictionaries") or {}, doc.get("exclusions") or {}
    take = lambda d, k: tuple(dict.fromkeys(str(x).strip().lower() for x in d.get(k) or () if str(x).strip()))
    names = tuple(str(c["name"]).lower() for c in doc.get("communities") or () if c.get("name"))
    return Lexicon(*[take(words, k) for k in ("platforms", "products", "vehicle_terms", "scenarios", "brands", "slang")], take(out, "non_diesel_terms"), take(out, "excluded_subreddits"), take(out, "promotional_terms"), names)
