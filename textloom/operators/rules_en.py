"""English tokenizer rules: affixes, infixes, whole-chunk matches and special cases.

Letters are classes of Unicode properties; contractions are built from grids of
subjects and endings. What must be listed is listed as fixed values.
"""

from __future__ import annotations

import functools

import regex

LOWER, UPPER, LETTER, ICON = r"\p{Ll}\p{Lo}", r"\p{Lu}\p{Lo}", r"\p{L}", r"\p{So}"

# Punctuation, quotes, currencies, units.
PUNCT = "… …… , : ; ! ? ¿ ؟ ¡ ( ) [ ] { } < > _ # * & 。 ？ ！ ， 、 ； ： ～ · । ، ۔ ؛ ٪".split()
QUOTES = "' \" ” “ ` ‘ ´ ’ ‚ , „ » « 「 」 『 』 （ ） 〔 〕 【 】 《 》 〈 〉 〈 〉 ⟦ ⟧".split()
CURRENCY = "$ £ € ¥ ฿ US$ C$ A$ ﷼".split() + [chr(c) for c in range(0x20A0, 0x20C0)]
UNITS = (
    "km km² km³ m m² m³ dm dm² dm³ cm cm² cm³ mm mm² mm³ ha µm nm yd in ft kg g mg µg t lb oz m/s km/h kmh mph hPa Pa mbar "
    "mb MB kb KB gb GB tb TB T G M K % км км² км³ м м² м³ дм дм² дм³ см см² см³ мм мм² мм³ нм кг г мг м/с км/ч кПа Па мбар "
    "Кб КБ кб Мб МБ мб Гб ГБ гб Тб ТБ тб كم كم² كم³ م م² م³ سم سم² سم³ مم مم² مم³ غرام جرام جم كغ ملغ كوب اكواب").split()
HYPHENS = ("-", "–", "—", "--", "---", "——", "~")

_alt = lambda xs: "|".join(regex.escape(x) for x in sorted(xs, key=lambda x: (-len(x), x)))
_quote_class = "".join(regex.escape(q) for q in QUOTES)
_punct_class = "".join(regex.escape(p) for p in PUNCT if len(p) == 1)

PREFIX_LITERALS = frozenset(["§", "%", "=", "—", "–", *PUNCT, *QUOTES, *CURRENCY])
PREFIX_PATTERNS = [regex.compile(p) for p in (r"\+(?![0-9])", r"\.\.+", f"[{ICON}]")]
SUFFIX_PATTERNS = [regex.compile(p + r"\Z") for p in (
    f"(?:{_alt([*PUNCT, *QUOTES, *(q + s for q in chr(39) + '’' for s in 'sS'), '—', '–'])})", r"\.\.+", f"[{ICON}]", r"(?<=[0-9])\+", r"(?<=°[FfCcKk])\.",
    f"(?<=[0-9])(?:{_alt(CURRENCY)})", f"(?<=[0-9])(?:{_alt(UNITS)})", rf"(?<=[0-9{LOWER}%²\-\+{_punct_class}(?:{_quote_class})])\.", f"(?<=[{UPPER}][{UPPER}])" + r"\.")]
INFIX_PATTERNS = [regex.compile(p) for p in (
    r"\.\.+", "…", f"[{ICON}]", r"(?<=[0-9])[+\-\*^](?=[0-9-])", rf"(?<=[{LOWER}{_quote_class}])\.(?=[{UPPER}{_quote_class}])", f"(?<=[{LETTER}]),(?=[{LETTER}])",
    f"(?<=[{LETTER}])(?:{_alt(HYPHENS)})(?=[{LETTER}])", f"(?<=[{LETTER}0-9])[:<>=/](?=[{LETTER}])")]

# A URL or e-mail address: scheme, user, then a public IPv4 address or dotted names with a top level of letters, port, path.
_octets = r"(?!(?:10|127)(?:\.\d{1,3}){3})(?!(?:169\.254|192\.168)(?:\.\d{1,3}){2})(?!172\.(?:1[6-9]|2\d|3[0-1])(?:\.\d{1,3}){2})(?:[1-9]\d?|1\d\d|2[01]\d|22[0-3])(?:\.(?:1?\d{1,2}|2[0-4]\d|25[0-5])){2}(?:\.(?:[1-9]\d?|1\d\d|2[0-4]\d|25[0-4]))"
_names = rf"(?:(?:[A-Za-z0-9¡-￿][A-Za-z0-9¡-￿_-]{{0,62}})?[A-Za-z0-9¡-￿]\.)+(?:[{LOWER}]{{2,63}})"
URL = regex.compile(rf"(?:(?:[\w\+\-\.]{{2,}})://)?(?:\S+(?::\S*)?@)?(?:{_octets}|{_names})(?::\d{{2,5}})?(?:[/?#]\S*)?")


def _spellings(word: str) -> list[str]:
    """A word with its apostrophes both ways."""
    return [word] if "'" not in word else [word, word.replace("'", "’")]


@functools.cache
def special_cases() -> dict[str, tuple[tuple[str, str], ...]]:
    """Chunk to its pieces, each with its norm ('' where it has none of its own)."""
    out: dict[str, tuple[tuple[str, str], ...]] = {}

    def add(*pieces: tuple[str, str]) -> None:
        for k in range(2 if any("'" in t for t, _ in pieces) else 1):
            made = tuple((t.replace("'", "’") if k else t, n) for t, n in pieces)
            out["".join(t for t, _ in made)] = made

    def both(first: str, norm: str, *rest: tuple[str, str]) -> None:
        """As written and with a capital."""
        for f in (first, first[0].upper() + first[1:]):
            add((f, norm), *rest)

    norms = {"'m": "am", "'ll": "will", "'d": "'d", "'ve": "have", "'re": "are", "'s": "'s", "n't": "not"}

    def ending(first: str, norm: str, *ends: str, own: tuple[str, str] = ("", "")) -> None:
        """Endings with their apostrophes and without; before 've, 'd is would. own: endings, written with and without, that have no norm."""
        for k, drop in enumerate(("", "'")):
            parts = [(e.replace(drop, "") if drop else e, "" if e == own[k] else "would" if e == "'d" and len(ends) > 1 else norms[e]) for e in ends]
            both(first, norm, *parts)

    for p in ("i", "you", "he", "she", "it", "we", "they"):
        for ends in (("'ll",), ("'ll", "'ve"), ("'d",), ("'d", "'ve")):
            ending(p, p, *ends)
    ending("i", "i", "'m", own=("", "'m"))
    for m in ("'m", "m"):
        both("i", "i", (m, "am"), ("a", "gonna"))
    for p in ("i", "you", "we", "they"):
        ending(p, p, "'ve")
    for p in ("you", "we", "they"):
        ending(p, p, "'re")
    for p in ("he", "she", "it"):
        ending(p, p, "'s", own=("", "'s"))
    for w in ("who", "what", "when", "where", "why", "how", "there", "that", "this", "these", "those"):
        for ends in (("'ll",), ("'ll", "'ve"), ("'d",), ("'d", "'ve")):
            ending(w, w, *ends)
        if w not in ("these", "those"):
            ending(w, w, "'s", own=("", "'s"))
        if w not in ("that", "this"):
            ending(w, w, "'re")
            ending(w, w, "'ve", own=("'ve", ""))
    # Verbs that take n't and their norms; with the first group 've may follow.
    for v, norm in (("ca", "can"), ("could", "could"), ("do", "do"), ("does", "does"), ("did", "do"), ("had", "have"), ("may", "may"), ("might", "might"), ("must", "must"), ("need", "need"), ("ought", "ought"), ("sha", "shall"), ("should", "should"), ("wo", "will"), ("would", "would")):
        ending(v, norm, "n't")
        ending(v, norm, "n't", "'ve")
    for v, norm in (("ai", ""), ("is", "is"), ("are", "are"), ("was", "was"), ("were", "were"), ("have", "have"), ("has", "has"), ("dare", "dare")):
        ending(v, norm, "n't")
    for v in ("could", "might", "must", "should", "would"):
        ending(v, v, "'ve", own=("'ve", "'ve"))
    for a, an, b, bn in (("can", "can", "not", "not"), ("gon", "going", "na", "to"), ("got", "got", "ta", "to"), ("let", "let", "'s", "us"), ("c'm", "come", "on", ""), ("not", "", "'ve", "have"), ("not", "", "ve", "have")):
        both(a, an, (b, bn))
    both("how", "how", ("'d", ""), ("'y", "you"))
    for unit in "CFKcfk":
        add(("°", ""), (unit, ""), (".", ""))
    for y in ("y'", "y"):
        add((y, "you"), ("all", ""))
    for h in range(1, 13):
        for t, n in (("a.m.", "a.m."), ("am", "a.m."), ("p.m.", "p.m."), ("pm", "p.m.")):
            add((str(h), ""), (t, n))
    # Words with a norm.
    for pair in "doin'=doing goin'=going nothin'=nothing nuthin'=nothing ol'=old somethin'=something lovin'=loving havin'=having ma'am=madam o'clock=o'clock".split():
        word, norm = pair.split("=")
        for w in {word, word.rstrip("'")}:
            both(w, norm)
    for pair in "'S='s 's='s 'Cause=because 'cause=because 'cos=because 'Cos=because 'coz=because 'Coz=because 'cuz=because 'Cuz=because 'bout=about 'em=them 'll=will 'nuff=enough 're=are 'd=".split():
        word, norm = pair.split("=")
        add((word, norm))
    for pair in "em=them ll=will nuff=enough and/or=and/or w/o=without ‘S='s ‘s='s Mt.=Mount".split():
        word, norm = pair.split("=")
        out[word] = ((word, norm),)
    # Months, states, titles and other abbreviations.
    names = {
        "Jan.": "January", "Feb.": "February", "Mar.": "March", "Apr.": "April", "Jun.": "June", "Jul.": "July", "Aug.": "August", "Sep.": "September", "Sept.": "September",
        "Oct.": "October", "Nov.": "November", "Dec.": "December", "Ak.": "Alaska", "Ala.": "Alabama", "Ariz.": "Arizona", "Ark.": "Arkansas", "Calif.": "California", "Colo.": "Colorado",
        "Conn.": "Connecticut", "Del.": "Delaware", "Fla.": "Florida", "Ga.": "Georgia", "Ia.": "Iowa", "Id.": "Idaho", "Ill.": "Illinois", "Ind.": "Indiana", "Kan.": "Kansas",
        "Kans.": "Kansas", "Ky.": "Kentucky", "La.": "Louisiana", "Mass.": "Massachusetts", "Mich.": "Michigan", "Minn.": "Minnesota", "Miss.": "Mississippi", "N.C.": "North Carolina",
        "N.D.": "North Dakota", "N.H.": "New Hampshire", "N.J.": "New Jersey", "N.M.": "New Mexico", "N.Y.": "New York", "Neb.": "Nebraska", "Nebr.": "Nebraska", "Nev.": "Nevada",
        "Okla.": "Oklahoma", "Ore.": "Oregon", "Pa.": "Pennsylvania", "S.C.": "South Carolina", "Tenn.": "Tennessee", "Va.": "Virginia", "Wash.": "Washington", "Wis.": "Wisconsin"}
    out |= {k: ((k, v),) for k, v in names.items()}
    plain = (
        "Adm. Bros. co. Co. Corp. D.C. Dr. e.g. E.g. E.G. Gen. Gov. i.e. I.e. I.E. Inc. Jr. Ltd. Md. Messrs. Mo. Mont. Mr. Mrs. Ms. p.m. a.m. Ph.D. Prof. Rep. Rev. Sen. St. vs. v.s. "
        "ä. ö. ü. ' ’ '' ’’ — C++ \\\") <space> \\n \\t").split()
    out |= {k: ((k, ""),) for k in [*plain, *(c + "." for c in "abcdefghijklmnopqrstuvwxyz"), "\t", "\n", " "]}
    out["\u00a0"] = (("\u00a0", "  "),)
    # Emoticons.
    faces = (
        "(*_*) (-8 (-: (-; (-_-) (._.) (: (; (= (>_<) (^_^) (o: (¬_¬) (ಠ_ಠ) (╯°□°）╯︵┻━┻ )-: ): -_- -__- ._. 0.0 0.o 0_0 0_o 8) 8-) 8-D 8D :'( :') :'-( :'-) :( :(( :((( :() :) :)) :))) "
        ":* :-( :-(( :-((( :-) :-)) :-))) :-* :-/ :-0 :-3 :-> :-D :-O :-P :-X :-] :-o :-p :-x :-| :-} :/ :0 :1 :3 :> :D :O :P :X :] :o :o) :p :x :| :} :’( :’) :’-( :’-) ;) ;-) ;-D ;D ;_; "
        "<.< </3 <3 <33 <333 =( =) =/ =3 =D =[ =] =| >.< >.> >:( >:o ><(((*> @_@ O.O O.o O_O O_o V.V V_V XD XDD [-: [: [= ]= ^_^ ^__^ ^___^ o.0 o.O o.o o_0 o_O o_o v.v v_v xD xDD ¯\\(ツ)/¯ ಠ_ಠ ಠ︵ಠ").split()
    out |= {k: ((k, ""),) for k in faces}
    # Words of their own that a grid would split.
    for w in "ill its hell shell shed were well whore".split():
        out.pop(w, None)
        out.pop(w.capitalize(), None)
    return out
