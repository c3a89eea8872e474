"""Text functions: tokens, slugs, ids, markers, style."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Topic tags and what each is found by, in padded lower-case text.
TOPICS = {
    "ai": (" ai ", " llm ", " gpt ", " claude ", " model "),
    "automation": (" automation ", " automate ", " workflow "),
    "community": (" community ", " forum ", " discord "),
    "data": (" data ", " analytics ", " pipeline "),
    "design": (" design ", " designer ", " ux ", " ui "),
    "engineering": (" engineer ", " engineering ", " developer ", " software "),
    "gaming": (" game ", " gaming ", " roblox ", " fortnite "),
    "growth": (" growth ", " acquisition ", " retention "),
    "marketing": (" marketing ", " brand ", " campaign "),
    "product": (" product ", " roadmap ", " feature "),
    "sales": (" sales ", " revenue ", " pipeline "),
}
# Words that tokens for matching leave out.
STOPWORDS = (
    "a an and are as at be by for from how i in is it of on or our that the this to we with you your"
).split()


def slug(x: Column, empty: str = "unknown") -> Column:
    """Lower case, other than a-z and 0-9 as single hyphens, none at the ends."""
    s = F.regexp_replace(F.regexp_replace(F.lower(x), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(F.coalesce(s, F.lit("")) == "", empty).otherwise(s)


def unicode_slug(x: Column, empty: str = "unknown") -> Column:
    """The same, keeping letters and digits of any script."""
    s = F.regexp_replace(F.regexp_replace(F.lower(x), "[^\\p{L}\\p{N}]+", "-"), "^-+|-+$", "")
    return F.when(F.coalesce(s, F.lit("")) == "", empty).otherwise(s)


def stable_id(*parts: Column, sep: str = "::", digits: int = 16, prefix: str = "") -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws(sep, *parts), 256), 1, digits))


def none_if_blank(x: Column) -> Column:
    t = F.trim(x)
    return F.when(t != "", t)


def normalize(x: Column) -> Column:
    """White space collapsed, lower case, a space at each end: for substring matches of words."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(x), "\\s+", " ")), F.lit(" "))


#: Ways of cutting text into tokens, by name: what is matched, and the least length kept.
TOKENIZERS = {
    "alnum": ("[a-z0-9]+", 1),
    "joined": ("[a-z0-9][a-z0-9\\-_/]*", 1),
    "long": ("[a-z0-9]+", 4),
    "words": ("[a-z]+", 3),
}


def tokens(x: Column, mode: str = "alnum", drop: tuple[str, ...] | list[str] = ()) -> Column:
    """Tokens in order with repeats, of lower-cased text."""
    pattern, least = TOKENIZERS[mode]
    found = F.regexp_extract_all(F.lower(x), F.lit(pattern), F.lit(0))
    if least > 1:
        found = F.filter(found, lambda t: F.length(t) >= least)
    return F.filter(found, lambda t: ~t.isin(list(drop))) if drop else found


def token_set(x: Column, mode: str = "alnum", drop: tuple[str, ...] | list[str] = ()) -> Column:
    return F.array_distinct(tokens(x, mode, drop))


def tags(x: Column, lexicon: dict[str, tuple[str, ...]] = TOPICS, prefix: str = "topic_") -> Column:
    """Names of the lexicon any of whose words the normalized text holds, in the lexicon's order."""


    def found(padded: Column) -> Column:
        return F.array_compact(F.array(*(F.when(any_of(padded, words), prefix + name) for name, words in lexicon.items())))

    # through a lambda, so that the text is normalized once and not for every word
    return F.transform(F.array(normalize(x)), found)[0]


def any_of(x: Column, words: tuple[str, ...] | list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | x.contains(w)
    return out


def has_link(x: Column) -> Column:
    return any_of(x, ("http://", "https://", "www."))


# What marks a message as a bot's or the system's.
BOT_PATTERNS = (
    r"\bhas\s+(joined|left)\s+the\s+(channel|server|group|room|space|team)\b",
    r"\bpinned\s+a\s+message\b",
    r"\bwelcome\s+to\s+(the\s+)?(channel|server|community|workspace|discord|slack|team|room|subreddit)\b",
    r"\byou('?ve|\s+have)\s+been\s+(added|invited)\s+to\b",
    r"\bthis\s+(channel|room|space|thread)\s+is\s+for\b",
    r"\brule\s+(violation|enforcement)\b",
    r"^@?(system|admin|mod|moderator|bot|automod|automoderator)\b",
    r"\bauto-?(reply|response|generated|moderated|modded)\b",
    r"^\s*\[?\s*(bot|system|auto|mod)\s*[\]:]",
    r"@(channel|here|everyone|room|all|team|general|staff)",
    r"^\s*(attention|psa|fyi|reminder|friendly\s+reminder|heads\s+up)\s*[:!,]",
    r"^\s*public\s+service\s+announcement\b",
    r"^\s*\[?\s*(announcement|update|important|urgent)\s*[\]:]",
)
SHOUT_LETTERS, SHOUT_SHARE = 20, 0.8


def is_bot(x: Column) -> Column:
    """A bot pattern matches, or at least 80 % of 20 or more letters are upper case."""
    letters = F.length(F.regexp_replace(x, "[^\\p{L}]", ""))
    upper = F.length(F.regexp_replace(x, "[^\\p{Lu}]", ""))
    # a shorter text has fewer letters, which needs no counting
    shouts = (F.length(x) >= SHOUT_LETTERS) & (letters >= SHOUT_LETTERS) & (upper >= SHOUT_SHARE * letters)
    return x.rlike("(?i)" + "|".join(BOT_PATTERNS)) | shouts


def marker_count(x: Column, words: list[str] | tuple[str, ...]) -> Column:
    """How often any of the words occurs as a whole word, whatever the case."""
    return F.regexp_count(x, F.lit("(?i)\\b(" + "|".join(words) + ")\\b"))


STYLE_LENGTH, STYLE_WORDS = 2000, 200


def style(x: Column) -> dict[str, Column]:
    """Eight features of how a message is written, each about 0 to 1."""
    n = F.greatest(F.lit(1), F.length(x))
    words = F.filter(F.split(x, "\\s+"), lambda w: w != "")
    n_words = F.greatest(F.lit(1), F.size(words))
    sentences = F.filter(F.split(F.regexp_replace(F.trim(x), "([.!?])\\s+", "$1\n"), "\n"), lambda s: s != "")
    n_sentences = F.greatest(F.lit(1), F.size(sentences))
    count = lambda p: F.regexp_count(x, F.lit(p))
    one = F.lit(1.0)
    return {
        "length": F.least(one, F.length(x) / STYLE_LENGTH),
        "word_length": F.least(one, F.length(F.array_join(words, "")) / n_words / 10),
        "punctuation": F.least(one, count("[.,;:!?\\-—–()\\[\\]{}\"'`]") / n * 5),
        "apostrophes": F.least(one, count("['’]") / n_words * 3),
        "fragments": F.size(F.filter(sentences, lambda s: ~F.substring(s, -1, 1).isin(".", "!", "?"))) / n_sentences,
        "non_ascii": F.least(one, count("[^\\x00-\\x7f]") / n * 10),
        "capitals": F.size(F.filter(sentences, lambda s: F.substring(s, 1, 1).rlike("\\p{Lu}"))) / n_sentences,
        "words": F.least(one, F.size(words) / F.lit(STYLE_WORDS)),
    }


def style_signature(x: Column) -> Column:
    return F.array(*(c.cast("double") for c in style(x).values()))
