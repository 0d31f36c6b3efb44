"""Text scalar functions as native Spark column expressions (no Python UDF).

Cleaning order is fixed: tokenise -> lower-case -> drop stop words ->
keep alphanumeric tokens -> (lemma, see ``operators.lemma``) -> join by one
space.  Stop words are tested before the alphanumeric filter, so ``don't``
becomes ``do`` + ``n't`` and both vanish.

The tokeniser is a chain of ``regexp_replace`` rules approximating the
Penn-Treebank word rules run after sentence splitting.  Only pure
letter/digit tokens survive the pipeline, so the rules only have to decide
which letter/digit runs become stand-alone tokens.  No trained sentence
model is available: every token-final period followed by white space is
treated as a sentence end (documented divergence for abbreviations such as
``Mr.``).  Each rule is written once and rendered both for Spark (Java
regex) and for DuckDB (RE2) so the oracle SQL runs the very same rules.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F

# ----------------------------------------------------------------- fixed values
# English stop-word list (the 179-word list commonly shipped with NLTK).
STOP_WORDS = (
    "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you", "you're",
    "you've", "you'll", "you'd", "your", "yours", "yourself", "yourselves", "he",
    "him", "his", "himself", "she", "she's", "her", "hers", "herself", "it", "it's",
    "its", "itself", "they", "them", "their", "theirs", "themselves", "what",
    "which", "who", "whom", "this", "that", "that'll", "these", "those", "am", "is",
    "are", "was", "were", "be", "been", "being", "have", "has", "had", "having",
    "do", "does", "did", "doing", "a", "an", "the", "and", "but", "if", "or",
    "because", "as", "until", "while", "of", "at", "by", "for", "with", "about",
    "against", "between", "into", "through", "during", "before", "after", "above",
    "below", "to", "from", "up", "down", "in", "out", "on", "off", "over", "under",
    "again", "further", "then", "once", "here", "there", "when", "where", "why",
    "how", "all", "any", "both", "each", "few", "more", "most", "other", "some",
    "such", "no", "nor", "not", "only", "own", "same", "so", "than", "too", "very",
    "s", "t", "can", "will", "just", "don", "don't", "should", "should've", "now",
    "d", "ll", "m", "o", "re", "ve", "y", "ain", "aren", "aren't", "couldn",
    "couldn't", "didn", "didn't", "doesn", "doesn't", "hadn", "hadn't", "hasn",
    "hasn't", "haven", "haven't", "isn", "isn't", "ma", "mightn", "mightn't",
    "mustn", "mustn't", "needn", "needn't", "shan", "shan't", "shouldn",
    "shouldn't", "wasn", "wasn't", "weren", "weren't", "won", "won't", "wouldn",
    "wouldn't",
)

# White space as Python's str.split() sees it, beyond ASCII \s.
EXOTIC_WS = r"[\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
WS = r"\s"

# Word-splitting fused forms: (head, tail).
FUSED_WORDS = (("can", "not"), ("gim", "me"), ("gon", "na"), ("got", "ta"),
               ("lem", "me"), ("wan", "na"))

# Clitics split off the word they follow.
CLITICS = ("'s", "'m", "'d", "'ll", "'re", "'ve", "n't")

_PUNCT = r"[«“‘„»”’\"`;@#$%&?!*\[\](){}<>]"

# Portable tokeniser rules in order: (pattern, replacement), ``{n}`` = group n.
# Written for RE2 (no look-around); this is the form the DuckDB oracle runs.
TOKEN_RULES: tuple[tuple[str, str], ...] = (
    # every Unicode space becomes a plain space
    (EXOTIC_WS, " "),
    # quotes, brackets and the always-separate punctuation
    (_PUNCT, " {0} "),
    # ellipsis
    (r"\.{2,}", " {0} "),
    # comma / colon not followed by a digit (so 1,000 and 10:30 stay whole)
    (r"([:,])([^0-9])", " {1} {2}"),
    # token-final period before white space = sentence end
    (r"([^.\s])\.('*)(\s)", "{1} . {2}{3}"),
    # double dash
    (r"--", " {0} "),
    # double every gap so that the boundary rules below never share a space
    (r"\s+", "  "),
    # closing single quote
    (r"([^'\s])'(\s)", "{1} '{2}"),
    # clitics
    (r"(?i)([^'\s])(" + "|".join(CLITICS) + r")(\s)", "{1} {2}{3}"),
) + tuple(
    (r"(?i)(\s)(" + h + r")(" + t + r")(\s)", "{1}{2} {3}{4}")
    for h, t in FUSED_WORDS
)

# Every white space above U+00FF: replaced one by one, each a search for bytes.
_WIDE_SPACES = tuple(chr(c) for c in (0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))
_NARROW_SPACES = r"[\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}]"
_WIDE_PUNCT = "“‘„”’"

# The same rules for Java regex.  Each begins with one character or a class below
# U+0100, which is looked up in a table; what must stand before it is looked at
# after it has been found.  A rule that begins with a look-behind, an alternation
# or a class beyond U+00FF costs ten times as much at every character of a text.
# The oracle test checks that both forms give identical tokens on the test corpora.
SPARK_TOKEN_RULES: tuple[tuple[str, str], ...] = (
    ("[" + "".join(c for c in _PUNCT[1:-1] if c not in _WIDE_PUNCT) + "]", " {0} "),
    (r"\.{2,}", " {0} "),
    (r"([:,])([^0-9])", " {1} {2}"),
    (r"\.(?<=[^.\s]\.)('*)(?=\s)", " . {1}"),
    (r"--", " {0} "),
    (r"['nN](?:'[tT](?=\s)(?<=[^'\s][nN]'[tT])|(?<=[^'\s]')(?:[sSmMdD]|[lL]{2}|[rRvV][eE])?(?=\s))", " {0}"),
    ("(?i)[" + "".join(sorted({h[0] for h, _ in FUSED_WORDS})) + r"](?<=\s.)(?:"
     + "|".join(rf"(?<={h[0]}){h[1:]}(?={t}\s)" for h, t in FUSED_WORDS) + ")", "{0} "),
)

# The same rules for T1-T4 as a whole.  Punctuation never survives T4, so a mark that
# stands alone is replaced by a space at once: one pass for what needs three above.
CLEAN_RULES: tuple[tuple[str, str], ...] = (
    ("[." + _NARROW_SPACES[1:-1] + SPARK_TOKEN_RULES[0][0][1:-1] + r"](?:(?<!\.)|(?<=\.)\.++)", " "),
    (r"[:,]([^0-9])", " {1}"),
    (r"\.(?<=[^.\s]\.)('*)(?=\s)", " {1}"),
)
CLITIC_RULE, FUSED_RULE = SPARK_TOKEN_RULES[-2:]
CLEAN_WORD = r"\s(?!\s)([0-9a-z]*+[\p{L}\p{N}]*+)(?=\s)"  # a token of letters and numbers between white space

ALNUM = r"^(?!$)[0-9A-Za-z]*+[\p{L}\p{N}]*+$"  # str.isalnum() over Unicode letters and numbers, ASCII ones first
ALNUM_RE2 = r"[\p{L}\p{N}]+"         # for DuckDB regexp_full_match
VOCAB_MIN_LEN = 2                    # vectoriser keeps words of two or more characters


def _java_repl(r: str) -> str:
    out = r
    for g in range(10):
        out = out.replace("{%d}" % g, "$%d" % g)
    return out


def _re2_repl(r: str) -> str:
    out = r
    for g in range(10):
        out = out.replace("{%d}" % g, "\\%d" % g)
    return out


# ------------------------------------------------------------ Spark expressions

def _ascii_or(x: Column, wide: Column) -> Column:
    """``wide`` for a text with characters beyond ASCII, else the text itself."""
    return F.when(F.octet_length(x) == F.length(x), x).otherwise(wide)


def _plain_wide(x: Column) -> Column:
    for c in _WIDE_SPACES:
        x = F.replace(x, F.lit(c), F.lit(" "))
    return x


def _where(x: Column, test, change) -> Column:
    """``change(x)`` where ``test(x)`` holds, else ``x``; bound to a name, as an expression
    that stands in a ``when`` several times would be evaluated as often."""
    return F.get(F.transform(F.array(x), lambda v: F.when(test(v), change(v)).otherwise(v)), 0)


def _narrow(x: Column) -> Column:
    """Wide spaces and quotation marks become spaces."""
    x = _plain_wide(x)
    for q in _WIDE_PUNCT:
        x = F.replace(x, F.lit(q), F.lit(" "))
    return x


def _has_wide(x: Column) -> Column:
    """Whether a text has bytes that the characters of ``_WIDE_SPACES`` and ``_WIDE_PUNCT`` begin with."""
    b = x.cast("binary")
    heads = sorted({c.encode()[:2] for c in (*_WIDE_SPACES, *_WIDE_PUNCT)})
    return functools.reduce(Column.__or__, [F.contains(b, F.lit(h)) for h in heads])


def plain_spaces(x: Column) -> Column:
    """Every white space of ``EXOTIC_WS`` becomes a plain space."""
    return F.regexp_replace(_ascii_or(x, _plain_wide(x)), _NARROW_SPACES, " ")


def _apply_rules(c: Column) -> Column:
    x = F.concat(F.lit(" "), F.coalesce(c.cast("string"), F.lit("")), F.lit(" "))
    wide = _plain_wide(x)
    for q in _WIDE_PUNCT:
        wide = F.replace(wide, F.lit(q), F.lit(f" {q} "))
    x = F.regexp_replace(_ascii_or(x, wide), _NARROW_SPACES, " ")
    for pat, rep in SPARK_TOKEN_RULES:
        x = F.regexp_replace(x, pat, _java_repl(rep))
    return x


def _split_ws(x: Column) -> Column:
    return F.array_remove(F.split(x, r"\s+"), "")


def tokenize(c) -> Column:
    """Raw tokens of a text (null -> empty array)."""
    c = F.col(c) if isinstance(c, str) else c
    return _split_ws(_apply_rules(c))


def normalize_case(tokens) -> Column:
    """Lower-case every token."""
    tokens = F.col(tokens) if isinstance(tokens, str) else tokens
    return F.transform(tokens, lambda t: F.lower(t))


def remove_stopwords(tokens, stop_words=STOP_WORDS) -> Column:
    """Drop stop words, keeping order and repeats (not a set difference)."""
    tokens = F.col(tokens) if isinstance(tokens, str) else tokens
    stops = list(stop_words)
    return F.filter(tokens, lambda t: ~t.isin(stops))


def filter_alnum(tokens) -> Column:
    """T4: keep tokens made only of Unicode letters and digits."""
    tokens = F.col(tokens) if isinstance(tokens, str) else tokens
    return F.filter(tokens, lambda t: t.rlike(ALNUM))


def lower_tokens(c) -> Column:
    """T1+T2 in one pass: rules, one ``lower`` over the whole text, split."""
    c = F.col(c) if isinstance(c, str) else c
    return _split_ws(F.lower(_apply_rules(c)))


def clean_tokens(c, stop_words=STOP_WORDS) -> Column:
    """The cleaned token list of a text, before lemmatisation: what
    ``filter_alnum(remove_stopwords(lower_tokens(c)))`` gives, in fewer passes.
    A rule for what few texts have is applied to those only, which a byte search finds."""
    c = F.col(c) if isinstance(c, str) else c
    x = F.concat(F.lit(" "), F.coalesce(c.cast("string"), F.lit("")), F.lit(" "))
    x = _where(x, _has_wide, _narrow)
    for pat, rep in CLEAN_RULES:
        x = F.regexp_replace(x, pat, _java_repl(rep))
    x = F.replace(x, F.lit("--"), F.lit(" "))
    x = _where(x, lambda v: F.contains(v, F.lit("'")), lambda v: F.regexp_replace(v, CLITIC_RULE[0], _java_repl(CLITIC_RULE[1])))
    x = _where(F.lower(x), lambda v: functools.reduce(Column.__or__, [F.contains(v, F.lit(h + t)) for h, t in FUSED_WORDS]),
               lambda v: F.regexp_replace(v, FUSED_RULE[0], _java_repl(FUSED_RULE[1])))
    return remove_stopwords(F.regexp_extract_all(x, F.lit(CLEAN_WORD), F.lit(1)), stop_words)


def join_tokens(tokens) -> Column:
    """Tokens joined by one space."""
    tokens = F.col(tokens) if isinstance(tokens, str) else tokens
    return F.array_join(tokens, " ")


def whitespace_split(c) -> Column:
    """``str.split()`` of a processed text."""
    c = F.col(c) if isinstance(c, str) else c
    return _split_ws(plain_spaces(F.coalesce(c.cast("string"), F.lit(""))))


def vocab_token(token) -> Column:
    """Predicate for tokens the vectoriser would keep."""
    token = F.col(token) if isinstance(token, str) else token
    return F.length(token) >= VOCAB_MIN_LEN


# ------------------------------------------------------------ DuckDB SQL twins

def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _apply_rules_sql(expr: str) -> str:
    x = f"(' ' || coalesce(CAST({expr} AS VARCHAR), '') || ' ')"
    for pat, rep in TOKEN_RULES:
        x = f"regexp_replace({x}, {_q(pat)}, {_q(_re2_repl(rep))}, 'g')"
    return x


def _split_ws_sql(x: str) -> str:
    return f"list_filter(string_split_regex({x}, '\\s+'), lambda t: length(t) > 0)"


def tokenize_sql(expr: str) -> str:
    return _split_ws_sql(_apply_rules_sql(expr))


def lower_tokens_sql(expr: str) -> str:
    return _split_ws_sql(f"lower({_apply_rules_sql(expr)})")


def stop_list_sql(stop_words=STOP_WORDS) -> str:
    return "[" + ", ".join(_q(w) for w in stop_words) + "]"


def remove_stopwords_sql(tokens: str, stop_words=STOP_WORDS) -> str:
    return f"list_filter({tokens}, lambda t: NOT list_contains({stop_list_sql(stop_words)}, t))"


def filter_alnum_sql(tokens: str) -> str:
    return f"list_filter({tokens}, lambda t: regexp_full_match(t, {_q(ALNUM_RE2)}))"


def clean_tokens_sql(expr: str, stop_words=STOP_WORDS) -> str:
    return filter_alnum_sql(remove_stopwords_sql(lower_tokens_sql(expr), stop_words))


def whitespace_split_sql(expr: str) -> str:
    return _split_ws_sql(f"regexp_replace(coalesce(CAST({expr} AS VARCHAR), ''), {_q(EXOTIC_WS)}, ' ', 'g')")
