"""A mail's own words, by column functions alone: without quoted parts, signature and disclaimers.

What is known of mails stands in tables of words; expressions are built from those. The lines
of a mail are an array: the first line that begins a quoted part ends it, then the last lines
are searched for a closing, then each paragraph loses the sentences of disclaimers.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Longest state made of a mail.
MOST = 3000

# Fixed values. How a client opens and ends the line over a quotation, and whether that line needs a digit (a date) to be one.
ATTRIBUTIONS = (("On", ("wrote",), False), ("Em", ("escreveu",), True), ("El", ("escribió", "escribio"), True))
#: Lines between dashes over a quotation.
DIVIDERS = ("original message", "forwarded message", "mensagem original", "mensagem encaminhada", "mensaje original", "mensaje reenviado")
#: A header line that follows a sender's name; the second group needs a year.
SENT = (("Enviado:", "Enviada:", "Enviado em:", "Enviada em:", "Enviado el:", "Enviada el:"), ("Data:", "Fecha:"))
#: Closings that a name may follow, and words that may stand between.
CLOSINGS = ("best", "kind", "warmest", "warm", "many thanks", "thanks", "thank you", "regards", "cheers", "sincerely")
AFTER_CLOSINGS = ("and regards", "& regards", "regards", "wishes", "again", "in advance", "a lot", "so much", "very much")
#: Closings that are a line by themselves, and what may end some of them.
ALONE = ("atenciosamente", "att", "abraço", "abraços", "abs", "um abraço", "cordialmente", "grato", "grata", "cumprimentos", "com os melhores cumprimentos", "saudações", "saludo", "saludos", "un saludo", "un saludos", "saludo cordiales", "saludos cordiales", "un saludo cordiales", "un saludos cordiales", "atentamente", "gracias", "muchas gracias", "gracias de antemano", "muchas gracias de antemano")
OBLIGED, OBLIGED_ENDS = ("obrigado", "obrigada", "obrigados", "obrigadas"), ("", " desde já", " pela atenção")
#: What a device puts under a mail: openings, devices, and words between and behind these.
SENT_FROM = ("sent from", "sent from my") + tuple(f"{verb} {way}{whose}" for verb in ("enviado", "enviada") for way in ("do", "pelo", "pela", "via", "desde", "a partir do") for whose in ("", " meu", " minha", " mi"))
DEVICES = ("iphone", "ipad", "android", "ios", "celular", "telemóvel", "móvil", "galaxy", "smartphone", "samsung", "tablet", "outlook", "yahoo", "mail", "e-mail", "email", "gmail", "windows")
BETWEEN_DEVICES = ("para", "for", "no", "na")
APPS = ("obter outlook para ios", "obter outlook para android", "get outlook for ios", "get outlook for android", "obter outlook for ios", "obter outlook for android", "get outlook para ios", "get outlook para android")
_MAIL_PT = ("mensagem", "email", "e-mail", "mensaje", "correo")
_THIS = tuple(f"{this} {what}" for this in ("esta", "este") for what in _MAIL_PT)
_GREEN = ("meio ambiente", "medio ambiente")
#: Disclaimers: groups of words and how many characters, no full stop among them, may lie between one group and the next. A star ends a beginning of words.
DISCLAIMERS = (
    (("email", "e-mail", "message", "information", "communication", "transmission", "content", "contents"), 60, ("confidential",), 60, ("intended", "solely", "addressee*", "recipient*", "privileged", "disclos*", "unauthorised", "unauthorized")),
    (("confidential",), 60, ("and may privileged", "and is privileged", "and may also privileged", "and is also privileged", "and may be privileged", "and may also be privileged")),
    (("if you received this", "if you have received this"), 1, ("email in error", "e-mail in error", "message in error")),
    (_THIS, 80, ("confidencia*", "sigilos*", "privilegiad*")),
    (("uso exclusivo", "exclusivamente", "únicamente", "unicamente"), 30, ("destinatári*", "destinatari*", "pessoa*", "persona*", "entidade*", "entidad*")),
    (("recebeu", "recebido", "receber"), 1, tuple(f"{this} {what}" for this in ("esta", "este") for what in ("mensagem", "email", "e-mail")), 20, ("por engano", "por erro")),
    (("ha recibido", "recibió", "recibe"), 1, tuple(f"{this} {what}" for this in ("esta", "este") for what in ("mensaje", "correo")), 20, ("por error",)),
    (("antes de imprimir",), 100, (*_GREEN, "natureza", "planeta", "realmente necess*")),
    (_GREEN, 30, ("antes de imprimir",)),
)


def _any(words: tuple[str, ...]) -> str:
    """An expression for one of the words, longest first; blanks stand for any white space."""
    plain = lambda w: "".join("\\" + c if c in ".&-" else c for c in w.rstrip("*")).replace(" ", r"\s+")
    return "(?:" + "|".join(plain(w) + (r"\w*" if w.endswith("*") else "") for w in sorted(words, key=len, reverse=True)) + ")"


def _rule(rule: tuple) -> str:
    parts = [rf"\b{_any(rule[0])}\b"]
    for gap, group in zip(rule[1::2], rule[2::2], strict=True):
        parts.append(rf"[^.]{{0,{gap}}}\b{_any(group)}")
    return "".join(parts)


_CI = "(?iu)"
_HEAD = rf"{_CI}^\s*{_any(tuple(a for a, _, _ in ATTRIBUTIONS))} (?=.*[0-9])"
_ATTRIBUTION = _CI + "|".join(rf"(?:^\s*{opens} {'(?=.*[0-9])' if dated else ''}.*{_any(verbs)}:\s*$)" for opens, verbs, dated in ATTRIBUTIONS)
_TAIL = rf"{_CI}^.*\S@\S+\s+{_any(tuple(v for _, verbs, _ in ATTRIBUTIONS for v in verbs))}:\s*$"
_DIVIDER = rf"{_CI}^\s*-{{2,}}\s*{_any(DIVIDERS)}\s*-{{2,}}"
_SENT = rf"{_CI}^\s*(?:{_any(SENT[0])}\s|{_any(SENT[1])}\s.*[0-9]{{4}})"
_CLOSING = rf"{_CI}^\s*{_any(CLOSINGS)}(?:\s+{_any(AFTER_CLOSINGS)})?(?!\w)"
_DISCLAIMER = _CI + "|".join(map(_rule, DISCLAIMERS))


def _is(line: Column, pattern: str) -> Column:
    return F.rlike(line, F.lit(pattern))


def _begins_quote(line: Column, following: Column) -> Column:
    """Whether a line begins a quoted part: an attribution, a divider, a rule of underscores, or the header of a mail."""
    header = _is(line, rf"{_CI}^\s*From:\s\s*\S") | _is(line, rf"{_CI}^\s*De:\s.*[@<]")
    named = _is(line, rf"{_CI}^\s*De:\s+\S") & F.coalesce(_is(following, _SENT), F.lit(False))
    return _is(line, _ATTRIBUTION) | _is(line, _DIVIDER) | _is(line, r"^\s*_{8,}\s*$") | header | named


def _own_lines(lines: Column) -> Column:
    """Lines before the first quoted part, quoted ones among them left out. The first own line begins none."""
    marked = F.transform(lines, lambda line, i: F.struct(line.alias("line"), F.startswith(F.ltrim(line), F.lit(">")).alias("quoted"), (_begins_quote(line, F.get(lines, i + 1))).alias("begins"), _is(line, _TAIL).alias("tail"), i.alias("i")))

    def kept(rows: Column) -> Column:
        own = F.filter(rows, lambda r: ~r["quoted"])
        ends = F.filter(rows, lambda r: (r["begins"] | r["tail"]) & (r["i"] > F.get(own, F.lit(0))["i"]))
        before = lambda end: F.filter(own, lambda r: end.isNull() | (r["i"] < end["i"]))

        def cut(end: Column) -> Column:
            return F.transform(F.array(before(end)), lambda ls: F.when(end["tail"] & ~end["begins"] & _is(F.element_at(ls, -1)["line"], _HEAD), F.slice(ls, F.lit(1), F.size(ls) - 1)).otherwise(ls))[0]

        return F.transform(F.array(F.get(ends, F.lit(0))), cut)[0]

    return F.transform(F.transform(F.array(marked), kept)[0], lambda r: F.regexp_replace(r["line"], r"\s+$", ""))


def _signs_off(line: Column) -> Column:
    """Whether a line is a closing or what a device puts under a mail."""
    bare = F.trim(line)
    rest = F.filter(F.split(F.regexp_replace(line, _CLOSING, ""), r"[\s,;:!.]+"), lambda w: w != "")
    name = F.forall(rest, lambda w: _is(w, r"^[\p{L}&&[^\p{Ll}]]"))
    closing = _is(line, _CLOSING) & (F.size(rest) <= 3) & name
    low = F.lower(F.regexp_replace(bare, r"[\s,!.]+$", ""))
    obliged = [f"{much}{who}{end}" for much in ("", "muito ") for who in OBLIGED for end in OBLIGED_ENDS]
    short = (bare == "--") | closing | low.isin(*ALONE, *obliged)
    words = F.split(F.regexp_replace(low, rf"^{_any(SENT_FROM)}\s+", ""), " ")
    device = _is(low, rf"^{_any(SENT_FROM)}\s+\S") & words[0].isin(*DEVICES) & F.forall(words, lambda w: w.isin(*DEVICES, *BETWEEN_DEVICES) | _is(w, "^[0-9]+$"))
    return ((F.length(bare) <= 40) & short) | ((F.length(bare) <= 60) & (device | low.isin(*APPS)))


def _unsigned(lines: Column) -> Column:
    """Lines before a closing, looked for from three fifths on, or in the last eight lines if there are more in these; never in the first."""

    def cut(ls: Column) -> Column:
        n = F.size(ls)
        first = F.greatest(F.lit(1), F.least((n * 0.6).cast("int"), n - 8))
        at = F.filter(F.transform(ls, lambda line, i: F.when((i >= first) & _signs_off(line), i)), lambda i: i.isNotNull())
        return F.when(F.size(at) > 0, F.slice(ls, F.lit(1), F.get(at, F.lit(0)))).otherwise(ls)

    return F.transform(F.array(lines), cut)[0]


def _plain(paragraph: Column) -> Column:
    """A paragraph without the sentences of disclaimers; one without any stays as it is. A line that a capital begins is a sentence of its own beside a disclaimer."""
    said = lambda x: _is(x, _DISCLAIMER)
    sentences = F.filter(F.transform(F.split(paragraph, r"(?<=[.!?])\s+"), F.trim), lambda x: x != "")
    pieces = lambda x: F.transform(F.split(x, r"\n(?=[^\p{L}\n]*\p{Lu})"), lambda y: F.trim(F.regexp_replace(y, r"\s*\n\s*", " ")))
    apart = F.flatten(F.transform(sentences, lambda x: F.when(said(x), pieces(x)).otherwise(F.array(x))))
    return F.when(said(paragraph), F.array_join(F.filter(apart, lambda x: ~said(x) & (x != "")), " ")).otherwise(paragraph)


def clean_mail(text: Column | str, most: int | None = MOST) -> Column:
    """A mail's own words, at most so many characters (whole: None); null for null."""
    body = F.col(text) if isinstance(text, str) else text
    lines = F.split(F.replace(F.regexp_replace(body, r"\r\n?", "\n"), F.lit("\\n"), F.lit("\n")), "\n", -1)
    own = F.array_join(_unsigned(_own_lines(lines)), "\n")
    paragraphs = F.filter(F.transform(F.split(own, r"\n\s*\n"), lambda p: F.regexp_replace(_plain(p), r"^\s+|\s+$", "")), lambda p: p != "")
    out = F.regexp_replace(F.array_join(paragraphs, "\n\n"), r"[ \t]+", " ")
    return out if most is None else F.left(out, F.lit(most))
