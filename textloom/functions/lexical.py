"""Context-free attributes of a token's text, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The stop words, lower-case; contractions occur with both apostrophes and the opening quote.
STOP_WORDS = frozenset(
    """a about above across after afterwards again against all almost alone along already also although always am among
    amongst amount an and another any anyhow anyone anything anyway anywhere are around as at back be became because become
    becomes becoming been before beforehand behind being below beside besides between beyond both bottom but by ca call can
    cannot could did do does doing done down due during each eight either eleven else elsewhere empty enough even ever every
    everyone everything everywhere except few fifteen fifty first five for former formerly forty four from front full further
    get give go had has have he hence her here hereafter hereby herein hereupon hers herself him himself his how however
    hundred i if in indeed into is it its itself just keep last latter latterly least less made make many may me meanwhile
    might mine more moreover most mostly move much must my myself name namely neither never nevertheless next nine no nobody
    none noone nor not nothing now nowhere of off often on once one only onto or other others otherwise our ours ourselves out
    over own part per perhaps please put quite rather re really regarding same say see seem seemed seeming seems serious
    several she should show side since six sixty so some somehow someone something sometime sometimes somewhere still such
    take ten than that the their them themselves then thence there thereafter thereby therefore therein thereupon these they
    third this those though three through throughout thru thus to together too top toward towards twelve twenty two under
    unless until up upon us used using various very via was we well were what whatever when whence whenever where whereafter
    whereas whereby wherein whereupon wherever whether which while whither who whoever whole whom whose why will with within
    without would yet you your yours yourself yourselves""".split()
) | {q + x for q in "'‘’" for x in ("d", "ll", "m", "re", "s", "ve")} | {"n" + q + "t" for q in "'‘’"}

# Words that count as numbers.
CARDINALS = tuple(
    """zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen
    nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion trillion quadrillion
    quintillion sextillion septillion octillion nonillion decillion gajillion bazillion""".split())
ORDINALS = tuple(
    """first second third fourth fifth sixth seventh eighth ninth tenth eleventh twelfth thirteenth fourteenth fifteenth
    sixteenth seventeenth eighteenth nineteenth twentieth thirtieth fortieth fiftieth sixtieth seventieth eightieth ninetieth
    hundredth thousandth millionth billionth trillionth quadrillionth quintillionth sextillionth septillionth octillionth
    nonillionth decillionth gajillionth bazillionth""".split())

#: Unicode White_Space, as a Java class.
SPACES = r"[\t-\r \x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"


def prefix(t: Column) -> Column:
    return F.substring(t, 1, 1)


def suffix(t: Column) -> Column:
    return F.right(t, F.lit(3))


def shape(t: Column) -> Column:
    """Digits to d, upper case to X, lower case to x, the rest as it is; from four characters on, runs are cut to four.

    Letters and digits map to private-use marks first, so that no replacement is mapped again.
    """
    marks = F.regexp_replace(F.regexp_replace(F.regexp_replace(t, r"\p{Lu}", "\ue000"), r"\p{Ll}", "\ue001"), r"\p{Nd}", "\ue002")
    mapped = F.translate(marks, "\ue000\ue001\ue002", "Xxd")
    return F.when(F.length(t) < 4, mapped).otherwise(F.regexp_replace(mapped, r"(?s)(.)\1{3,}", "$1$1$1$1"))


def is_alpha(t: Column) -> Column:
    return t.rlike(r"\A\p{L}+\z")


def is_digit(t: Column) -> Column:
    return t.rlike(r"\A\p{Nd}+\z")


def is_punct(t: Column) -> Column:
    return t.rlike(r"\A\p{P}+\z")


def is_space(t: Column) -> Column:
    """Of a lexeme: the empty string is no space."""
    return t.rlike(rf"\A{SPACES}+\z")


def is_space_or_empty(t: Column) -> Column:
    """Of matcher and ruler: the empty string is space."""
    return t.rlike(rf"\A{SPACES}*\z")


def is_space_feature(t: Column) -> Column:
    """Of the feature extractor: blank, tab, line feed and carriage return only."""
    return t.rlike(r"\A[ \t\n\r]+\z")


def is_lower(t: Column) -> Column:
    return t.rlike(r"\p{L}") & ~t.rlike(r"[\p{L}&&\P{Ll}]")


def is_upper(t: Column) -> Column:
    return t.rlike(r"\p{L}") & ~t.rlike(r"[\p{L}&&\P{Lu}]")


def is_title(t: Column) -> Column:
    return t.rlike(r"\A\P{L}*(\p{Lu}\p{Ll}*(\P{L}+|\z))+\z")


def is_ascii(t: Column) -> Column:
    return t.rlike(r"\A[\x00-\x7F]*\z")


def like_num_lexeme(t: Column) -> Column:
    return is_digit(t)


def like_num(t: Column) -> Column:
    """After one sign: digits (commas and points among them ignored), a plain fraction, a number word, or plain digits with st, nd, rd, th."""
    bare = F.regexp_replace(t, r"\A[+\-±~]", "")
    low = F.translate(bare, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_replace(bare, "[,.]", "").rlike(r"\A[0-9]+\z") | bare.rlike(r"\A[0-9]+/[0-9]+\z") | low.isin(*CARDINALS, *ORDINALS) | low.rlike(r"\A[0-9]+(st|nd|rd|th)\z")


def is_stop(t: Column) -> Column:
    return F.lower(t).isin(*sorted(STOP_WORDS))


def morph_has(morph: Column, feature: str) -> Column:
    """Whether a packed morphology (Feat=Val|Feat=Val) holds the exact feature."""
    return F.array_contains(F.split(F.coalesce(morph, F.lit("")), r"\|"), feature)


def morph_map(morph: Column) -> Column:
    """Feature to value; empty for '' and '_'."""
    return F.when(morph.isin("", "_"), F.create_map().cast("map<string,string>")).otherwise(F.str_to_map(morph, F.lit(r"\|"), F.lit("=")))


FLAGS = {"is_alpha": is_alpha, "is_digit": is_digit, "is_punct": is_punct, "is_space": is_space, "is_lower": is_lower, "is_upper": is_upper, "is_title": is_title, "is_ascii": is_ascii, "like_num": like_num_lexeme, "is_stop": is_stop}


def lexeme(t: Column) -> list[Column]:
    """All context-free columns of a token's text."""
    return [F.lower(t).alias("lower"), prefix(t).alias("prefix"), suffix(t).alias("suffix"), shape(t).alias("shape"), *[f(t).alias(n) for n, f in FLAGS.items()]]


def explain_label(label: Column) -> Column:
    """Entity label in words; unknown labels give the empty string."""
    # The eighteen labels.
    words = {
        "PERSON": "People, including fictional", "NORP": "Nationalities or religious or political groups", "FAC": "Buildings, airports, highways, bridges, etc.",
        "ORG": "Companies, agencies, institutions, etc.", "GPE": "Countries, cities, states", "LOC": "Non-GPE locations, mountain ranges, bodies of water",
        "PRODUCT": "Objects, vehicles, foods, etc. (not services)", "EVENT": "Named hurricanes, battles, wars, sports events, etc.", "WORK_OF_ART": "Titles of books, songs, etc.",
        "LAW": "Named documents made into laws.", "LANGUAGE": "Any named language", "DATE": "Absolute or relative dates or periods", "TIME": "Times smaller than a day",
        "PERCENT": 'Percentage, including "%"', "MONEY": "Monetary values, including unit", "QUANTITY": "Measurements, as of weight or distance", "ORDINAL": '"first", "second", etc.',
        "CARDINAL": "Numerals that do not fall under another type"}
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in words.items() for x in kv]), label), F.lit(""))
