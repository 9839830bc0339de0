"""Template residue, filler, error pages and script notices.

Documents are taken apart into lines without code and quoted spans, and lines into units (sentences). Units are masked (numbers, names with
digits or capitals, slots), and message templates are mined from them with a prefix tree of fixed depth: the leaf is given by a unit's
length and its first words; within a leaf, units alike in most places form a template. A template is classified once, from its texts in
all of the corpus:

1. Words only make it a suspect. A template whose texts mostly carry a cue (CUES: the usual words of failures, notices and filler), whose
   words are those of such templates rather than of the others (log odds learnt from the corpus), or that often shares a line with a cue,
   is a suspect.
2. Company decides. What is said in running text, in lines whose other words are mostly beyond suspicion, speaks of such things and is
   ordinary. A suspect with a cue that mostly stands otherwise is residue; a suspect without a cue is residue if it shares lines with cued
   ones more often than with ordinary ones, or, when it's always alone, if its words say so.

The verdict goes back to all units of the template. A line whose words are, for STANDS at least, units of residue stands in place of a
section, and its document is a case. Unresolved slots are looked for apart from that, in every ordinary line: in prose, headings and field
lines, not in code, formulas, sets, quotes, or sentences that speak of slots.

Filler without meaning shows by its words: hardly any of them is found in templates that several documents share, nor, word by word, in a
share of the texts of a language, and it lacks function words. That says something only where the corpus knows the language: with fewer
than LEAST_TEXTS distinct texts, or where a large part of its sentences would be judged so, absence gives no verdict. Nor does the absence
of fewer than LEAST_WORDS words. Keys struck at random and one unit over and over are filler in any language.

Only distinct units, suspects and their lines are shuffled; ordinary sentences never are after they are counted. A leaf of many units is
mined in parts of LEAF_UNITS whose templates are mined once more.

Defined cases: null, empty and blank texts are no cases; a repeated text is a case each time (support counts distinct texts); very long
texts are read whole; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Callable, Iterator
from operator import eq

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from axonlake.sources.scratch import materialize

DEPTH = 3
ALIKE = 0.8
#: Units of a leaf that one task mines at a time.
LEAF_UNITS = 50_000
#: Distinct texts that share a template from which on its words count as the corpus's own.
SUPPORT = 5
#: Share of a language's texts, two at least, from which on a word counts as heard wherever it stands.
HEARD = 0.01
#: Absence of words says nothing in a language of fewer distinct texts, or with a larger share of strange sentences among strange and ordinary ones.
LEAST_TEXTS = 20
MOST_STRANGE = 0.2
LEAST_WORDS = 4
#: Share of its texts in which a template without a cue shares a line with a cue, from which on it is a suspect, and with cued templates only, from which on it may be residue, whatever its words.
SUSPECT = 0.1
COMPANY = 0.25
#: Texts that a share is taken over besides those seen, as few texts prove little: a rare sentence that stands beside a cue once is no suspect's company for that alone.
FEW = 4
#: Share of the words of a line from which on residue stands in place of the line.
STANDS = 0.3
#: Words and sentences of which a Python worker remembers what was said of them, by function.
KEPT = 100_000
#: Rows of a broadcast side; above, a shuffle join does the same.
BROADCAST_ROWS = 200_000

_UP = "A-ZÇĞİÖŞÜÄÑÁÉÍÓÚ"
_MARKUP = {
    "html", "head", "title", "body", "p", "br", "hr", "div", "span", "b", "i", "em", "strong", "a", "li", "ul", "ol", "table", "tr", "td", "th", "script", "style", "img",
    "noscript", "h1", "h2", "h3", "h4", "h5", "h6", "error", "code", "message", "id", "pre", "xml", "sub", "sup", "small", "main", "nav", "section", "header", "footer",
}
_HERE = r"(?:here|hier|hier eintragen|hier einfügen|buraya|buraya yazın|aquí)"
_ASK = r"(?:insert|enter|add|your|fill in|type|choose|einfügen|eintragen|inserte|insertar|ponga|escriba|ekle|girin|yazın)"
SLOT = re.compile(
    r"\{\{[^{}\n]*\}\}|\{%[^%\n]*%\}|\[%[^%\n]*%\]|<%[^%\n]*%>|[$#]\{[^{}\n]+\}|\{(?P<sign>[*~=+:|!&-])[^{}\n]+(?P=sign)\}|%\([^()\n]+\)[sdf]|%\d+\$[sdf](?!\w)|(?<![\w%])%["
    + _UP + r"_]{3,}%|(?<![\w%\d])(?<!\d )%[sd](?!\w)|\[\[[^\[\]\n]+\]\]|<<[^<>\n]+>>|(?<!\w)__[^\W\d_]\w*?__(?!\w)|@@\w[\w ]*@@|(?<![\w.@])@[^\W\d]\w+@(?!\w)"
    r"|\*\*\*[^\W\d_][\w ]*\*\*\*|~~[^\W\d_][\w ]*~~|\[(?:[" + _UP + r"][" + _UP + r"_ ]{2,}|" + _ASK + r" [^\[\]\n]+|[^\[\]\n]+ " + _HERE + r"|[^\[\]\n]+ (?:einfügen|eintragen)|[^\W\d_]{3,}(?:[ _][^\W\d_]+)*|[^\W\d_]+(?:[ _][^\W\d_]+)+)\](?!\()"
    r"|<(?P<tag>[^\W\d_][\w .-]+)>|«(?P<said>[^\W\d_][\w]*(?: \w+){0,3})»|(?<![\w^_\\{$#])\{(?P<set>[^\W\d_][\w. ]{2,}|\d?)\}(?!\})"
    r"|\([^()\n]+ " + _HERE + r"\)|(?<!\w)X{3,}(?!\w)|(?<![\w_])_{3,}(?![\w_])|(?<![.\w])\.{5,}(?!\w)|(?<![.\w…])…{2,}|\bTBD_\w+|(?<!\w)\w+_HERE\b|(?<![\w$])\$[" + _UP + r"][" + _UP + r"_]{2,}(?!\w)"
)
#: What any slot contains; most lines have none of it.
_MAYBE_SLOT = re.compile(r"[\[{<]{2}|[{<\[][^\W\d_]|\{[*~=+:|!&-]|[\[{<]%|\{\d?\}|[$#]\{|%[(\w]|\$[^\W\d_]|@[@\w]|«\w|__|~~|\*\*\*|XXX|\.{5}|……|TBD_|_HERE|(?:here|hier|einfügen|eintragen|buraya|yazın|aquí)\)")


_SLOT_SIGN = re.compile(r"[{\[<$%@«~](?:[^\s\d,.;:)]|\d?\}|\d+\$)")


def may_hold_slot(x: str) -> bool:
    signs = (
        bool(_SLOT_SIGN.search(x)) or "__" in x or "***" in x or "XXX" in x or "....." in x or "……" in x or "TBD_" in x or "_HERE" in x
        or (")" in x and ("here)" in x or "hier)" in x or "fügen)" in x or "tragen)" in x or "raya)" in x or "azın)" in x or "aquí)" in x))
    )
    return signs and bool(_MAYBE_SLOT.search(x))


_QUOTED = re.compile(r'"[^"\n]+"|“[^“”\n]+”|„[^„“”\n]+[“”]|`[^`\n]+`|(?<!\w)‘[^‘’\n]+’|(?<![\w\'])\'(?=\S)[^\n]+?(?<=\S)\'(?=$|[\s.,;:!?)])(?!\w)')
_AROUND_QUOTE = re.compile(r"\s*‹q›\s*")
_MENTION = re.compile(
    r"\b(?:slots?|placeholders?|template|unfilled|draft|platzhalter|vorlage|entwurf|plantilla|borrador|marcadores|şablon\w*|taslak\w*|yer tutucu\w*)\b", re.I
)
_PLAIN = ("JS", "HTTP", "TODO", "FIXME")
_VARYING = frozenset("0123456789_‹*")
_EDGE = ".,;:!?()[]\"'"
_LINE_END = re.compile(r"\r\n|\r|\n")
_KEYWORDS = frozenset("def class import from return for while if elif else try except raise print function const let var".split())
_STATEMENT = re.compile(
    r"(?:def|class|import|from|return|for|while|if|elif|else|try|except|raise|print|function|const|let|var)\b[^.]*[(:{;=]|[\w.\[\]]+ ?[-+*/]?= ?\S|(?:#|//) *include"
)
_TABLE = re.compile(r"[^,\s]+(?:,[^,\s]*){3,}$")
_LOG = re.compile(r'\{"(?:seq|t|kind|ts|event)"')
_FORMULA = re.compile(r"\\(?:frac|sum|int|mathbb|sqrt|cdot|alpha|beta|left|right|text|mathrm)\b|\$[^$\n]{1,120}\$")
_BULLET = re.compile(r"^\s*(?:[-*•+>]\s+|\d+[.)]\s+)")
_STOP = re.compile(r"[.!?…]\s+")
_BREAK = re.compile(r" +[-–|] +| {2,}|<[^<>\n]{1,40}>")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")

_ERROR_BODY = re.compile(r'^\s*\{\s*"(?:error|err|fault|exception|errors)"\s*:|^\s*<(?:\?xml[^>]*>\s*<)?(?:Error|Fault)\b|^<Error>|<title>[^<]*(?:error|not found|denied|unavailable|gateway|forbidden|requests|hata|bulunamad|fehler|gefunden|denegado|encontrada|interno|caducad|abgelaufen|engellendi|aşım)', re.I)
#: The usual words of script notices, failures and filler, in lower case, as whole words; a star stands for any ending, a caret for the start. They make a template a suspect, no more.
CUES = {
    "notice": """
        javascript, java script, js, script, scripts, scripting, noscript, active content, skript, skripte, skripten, aktive inhalte, betik, betikler, komut dosyaları, contenido activo""",
    "error": """
        ^traceback, ^4xx, ^* 4xx, ^error 4xx, ^http/*, ^err_*, ^fatal, ^warning:, ^notice:, ^php warning:, ^php notice:, ^parse error:, *error:, *exception:, not found, forbidden, bad gateway, service unavailable, too many requests,
        internal server, gateway timeout, gateway time-out, unauthorized, access denied, session expired, session has expired, session has ended, token expired, link expired, timed out, went wrong, unexpected problem,
        unexpected error, unknown error, internal error, server error, couldn't load, couldn't reach, couldn't open, couldn't find, could not load, could not reach, could not open, could not find, could not be loaded,
        could not be found, could not be opened, could not be reached, try again, maintenance, out of memory, segmentation fault, core dumped, connection refused, connection reset, connection closed, closed the connection, connection error, connect error, error code,
        have permission, oops, nicht gefunden, serverfehler, verweigert, sitzung ist abgelaufen, zeitüberschreitung, erneut versuchen, konnte nicht geladen, schiefgelaufen, keine berechtigung, wartungsarbeiten, unerwarteter fehler,
        bulunamad*, sunucu hatası, engellendi, zaman aşımı*, yeniden deneyin, oturumunuz, yetkiniz, yüklenemedi, ters gitti, no encontrada, no encontrado, error interno, denegado, ha caducado, ha expirado, inténtelo, no se pudo,
        no tiene permiso, tiempo de espera, algo salió mal, demasiadas solicitudes""",
    "filler": """
        lorem, ipsum, dummy text, dummy copy, placeholder text, filler text, sample text, sample paragraph, sample heading, sample caption, sample body, example text, example paragraph, example heading, example caption, example body,
        caption text, body text, goes here, to be written, coming soon, under construction, is reserved for, are reserved for, füllabsatz, fülltext, blindtext, platzhaltertext, beispieltext, beispielabsatz, wird später ergänzt,
        wird noch ergänzt, wird noch geschrieben, deneme yazısı, örnek metin, örnek paragraf, örnek başlık, dolgu, sonra yazılacak, hazırlanıyor, texto de relleno, texto de ejemplo, párrafo de relleno, párrafo de ejemplo,
        pendiente de redactar, pendiente de escribir, de relleno""",
}


def _cue_finder() -> tuple[ahocorasick.Automaton, dict[str, str]]:
    """An automaton of the cues with their verdicts, and the cues that stand at the start."""
    found, starts = ahocorasick.Automaton(), {}
    for verdict, words in CUES.items():
        for word in (" ".join(w.split()) for w in words.split(",")):
            if word[0] == "^":
                starts[word[1:]] = verdict
            else:
                bare = word.strip("*")
                found.add_word(bare, (verdict, len(bare), word[0] == "*", word[-1] == "*"))
    found.make_automaton()
    return found, starts


_CUES, _STARTS = _cue_finder()
_RANK = list(CUES)
_KEYS = re.compile(r"^(?:asd|asdf|asdfg|qwe|qwer|qwert|qwerty|jkl|jkl[oö]|lkjh|fgh|fghj|dfg|dfgdfg|sdf|sdfg|hjkl|zxcv|zxc|yxcv|test|foo|bar|baz|bla|blah|xyz|abc|aaa|lorem|ipsum|foobar)$", re.I)


def blank_quotes(line: str) -> str:
    if not ("'" in line or '"' in line or "`" in line or "“" in line or "„" in line or "‘" in line):
        return line
    return _AROUND_QUOTE.sub(" ‹q› ", _QUOTED.sub("‹q›", line))


def slots(line: str, may: bool | None = None) -> list[str]:
    """The unresolved slots of a line of prose, heading or field; may is what may_hold_slot says of it, if known."""
    if not (may_hold_slot(line) if may is None else may):
        return []
    bare = _FORMULA.sub(" ", blank_quotes(line))
    found = []
    for m in SLOT.finditer(bare):
        tag = m.group("tag")
        if tag and (tag.lower().split()[0] in _MARKUP or "/" in tag):
            continue
        if m.group("set") is not None and (m.group("set").isdigit() and int(m.group("set")) > 9):
            continue
        if set(m.group()) <= set("_. …") and len(bare.strip()) == len(m.group()):
            continue  # a rule across the page
        start = max(bare.rfind(". ", 0, m.start()), bare.rfind("? ", 0, m.start())) + 1
        end = bare.find(". ", m.end())
        if not _MENTION.search(bare[start : end if end > 0 else len(bare)].replace(m.group(), " ")):
            found.append(m.group())
    return found


def _is_code(line: str, bare: str) -> bool:
    if line.startswith(("    ", "\t")):
        return True
    if bare[-1] in ";{" or bare[0] == "}" or (("=" in bare or bare.split(" ", 1)[0].strip(":(") in _KEYWORDS or "include" in bare) and _STATEMENT.match(bare)):
        return not (may_hold_slot(line) and SLOT.search(line))
    return False


def text_lines(text: str) -> Iterator[tuple[str, str]]:
    """(kind, line) of the text in composed letters: code, table or log lines are told from ordinary ones by form."""
    fenced = False
    text = unicodedata.normalize("NFC", text).replace("\u200b", "").replace("\ufeff", "").replace("\xa0", " ")
    for line in _LINE_END.split(text) if "\r" in text else text.split("\n"):
        bare = line.strip()
        if not bare:
            continue
        first = bare[0]
        if bare.startswith(("```", "~~~")):
            fenced = not fenced
            yield "code", line
        elif fenced:
            yield "code", line
        elif first == "{" and _LOG.match(bare):
            yield "log", line
        elif (first in "{<" or "<title>" in bare) and _ERROR_BODY.search(bare) or bare.startswith("Traceback (most recent") or (first == "<" and bare[:9].lower() == "<noscript"):
            yield "page", line
        elif _is_code(line, bare):
            yield "code", line
        elif first == "|" or (bare.count(",") >= 3 and _TABLE.match(bare)):
            yield "table", line
        else:
            yield "prose", line


def _star(token: str) -> str:
    core = token.strip(_EDGE)
    end = token[-1] if token[-1] in ".!?…:" else ""
    if len(core) == 3 and core[0] in "45" and core.isdigit():
        return "4xx" + end
    if core.lower().startswith(("http/", "err_")):
        return token
    return "*" + end


class _Known(dict):
    """What a function says of a text, kept for the next time; at most KEPT texts are held."""

    def __init__(self, of: Callable[[str], str | bool | None]) -> None:
        super().__init__()
        self.of = of

    def __missing__(self, text: str) -> str | bool | None:
        if len(self) >= KEPT:
            self.clear()
        self[text] = got = self.of(text)
        return got


def _mask(token: str) -> str:
    if token.isalpha():
        return "*" if len(token) > 1 and token.isupper() and token not in _PLAIN else token
    if not _VARYING.isdisjoint(token):
        return _star(token)
    if token.isupper() and len(core := token.strip(_EDGE)) > 1 and core not in _PLAIN:
        return "*"
    return token


_MASKS = _Known(_mask)
#: The same in a line of capitals.
_SHOUTED = _Known(lambda t: t if t.isalpha() or _VARYING.isdisjoint(t) else _star(t))


def _without_marks(x: str) -> str:
    return x.replace(".", "").replace(",", "").replace(";", "").replace("!", "").replace("?", "").replace("(", "").replace(")", "")


def _clean(token: str) -> str:
    """A masked token in lower case without marks but a last one that may end a sentence; a zero for one that could change where a line is cut."""
    low = token.lower()
    bare = _without_marks(low[:-1]) + low[-1:] if low[-1:] in (".", "!", "?", "…") else _without_marks(low)
    odd = low and (bare in ("", "-", "–", "|") or (bare[-1:] == "…" != low[-1]) or "<" in low or "\0" in low or low.split() != [low])
    return "\0" if odd else bare


_CLEAN, _SHOUTED_CLEAN = _Known(lambda t: _clean(_mask(t))), _Known(lambda t: _clean(_SHOUTED.of(t)))


def units(line: str, may: bool = True) -> list[str]:
    """The masked sentences of a line, without bullets: lower-case words; what varies from message to message, quoted spans and slots are `*`, a status code of failure is `4xx`."""
    bare = blank_quotes(line)
    if not bare[:1].isalpha():
        bare = _BULLET.sub("", bare)
    if may and may_hold_slot(bare):
        bare = SLOT.sub(" * ", bare)
    masks, clean = (_SHOUTED, _SHOUTED_CLEAN) if bare.isupper() else (_MASKS, _CLEAN)
    tokens = bare.replace("\t", " ").split(" ")
    bare = " ".join(map(clean.__getitem__, tokens))
    if "\0" in bare:
        bare = _STOP.sub("\n", " ".join(map(masks.__getitem__, tokens)).lower())
        if "  " in bare or " - " in bare or " – " in bare or " | " in bare or "<" in bare:
            bare = _BREAK.sub("\n", bare)
        bare = _without_marks(bare)
    else:
        bare = _STOP.sub("\n", bare)
        if "  " in bare or " - " in bare or " – " in bare or " | " in bare:
            bare = _BREAK.sub("\n", bare)
        if bare[-1:] in (".", "!", "?"):
            bare = bare[:-1]
    return [u for u in (x.strip() for x in bare.split("\n")) if u and (u.upper() != u or _WORD.search(u))]


def leaf(template: str) -> str:
    words = template.split()
    return f"{len(words)} {' '.join(words[:DEPTH])}"


def cluster(templates: list[tuple[str, int]]) -> list[tuple[str, str]]:
    """(masked unit, template) of one leaf: units of one length, taken by support and text, join the template most alike, in ALIKE of its places at least.
    Two of n words that are alike so far agree on one whole stretch of n words cut into as many as may differ and one more, so templates are looked up by stretch."""
    if len(templates) == 1:
        return [(templates[0][0], templates[0][0])]
    found: list[list[str]] = []
    by_stretch: dict[tuple, list[int]] = {}
    out = []
    for text, _ in sorted(templates, key=lambda t: (-t[1], t[0])):
        words = text.split()
        n = len(words)
        parts = int(n * (1 - ALIKE) + 1e-9) + 1
        keys = [(k, *words[k * n // parts : (k + 1) * n // parts]) for k in range(parts)]
        best, at = 0.0, -1
        for t in sorted({t for k in keys for t in by_stretch.get(k, ())}):
            same = sum(map(eq, words, found[t])) / max(1, n)
            if same > best:
                best, at = same, t
                if same == 1.0:
                    break
        if best < ALIKE:
            found.append(words)
            at = len(found) - 1
            for k in keys:
                by_stretch.setdefault(k, []).append(at)
        else:
            found[at] = [a if a == b else "*" for a, b in zip(words, found[at])]
        out.append((text, at))
    return [(text, " ".join(found[at])) for text, at in out]


def cue(unit: str) -> str | None:
    """What a unit's words make it suspect of, the first of CUES. Notes of open work are beyond suspicion."""
    if unit.startswith(("todo", "fixme")):
        return None
    got = set()
    for end, (verdict, n, any_start, any_end) in _CUES.iter(unit):
        first = end - n + 1
        if (any_start or first == 0 or not unit[first - 1].isalnum()) and (any_end or end + 1 == len(unit) or not unit[end].isalnum() or not unit[end + 1].isalnum()):
            got.add(verdict)
    for start, verdict in _STARTS.items():
        if unit.startswith(start.removesuffix("*")) and (start[-1] == "*" or len(unit) == len(start) or not unit[len(start)].isalnum()):
            got.add(verdict)
    return min(got, key=_RANK.index) if got else None


_CUED = _Known(cue)
_STRUCK = _Known(lambda w: bool(_KEYS.match(re.sub(r"\d", "", w))))

#: Words that hold sentences together, whatever they speak of, by language.
_FUNCTION_WORDS = tuple(
    frozenset(x.split())
    for x in (
        "the of and to is are was were be been with for from by at as that this it not which when while after before than then into on or its their they we our an has have had but if there where no",
        "der die das den dem des und ist sind war ein eine einen einem einer nicht mit von im in auf für als auch nach vor bei aus wird werden wurde sich dass wenn aber oder noch nur wer wo steht um",
        "el la los las de del y que en un una es son fue con por para no sus al como más pero cuando donde sobre entre desde hasta este esta ese otra otro vez",
        "ve bir bu şu da de ile için gibi kadar daha çok ama değil her olarak olan var yok sonra önce ise göre iki yine kez",
    )
)


def spoken(words: list[str]) -> bool:
    """Whether two different function words of one language are among the words."""
    own = set(words)
    return any(len(own & f) >= 2 for f in _FUNCTION_WORDS)


def drummed(words: list[str]) -> bool:
    """Whether a unit's words are keyboard walks, or one word over and over."""
    if len(words) < LEAST_WORDS:
        return False
    keys = sum(map(_STRUCK.__getitem__, words))
    return keys >= 0.6 * len(words) or (len(words) >= 8 and len(set(words)) <= 0.25 * len(words))


def meaningless(words: list[str], known: int) -> bool:
    """Whether a unit's words are drummed, or hardly any is known and they don't read as a sentence."""
    return len(words) >= LEAST_WORDS and (drummed(words) or (known <= 0.34 * len(words) and not spoken(words)))


def sense(unit: str, known: int) -> str:
    """filler (drummed), strange (filler, if its other words aren't heard either and the corpus knows the language) or ordinary."""
    words = _WORD.findall(unit.replace("4xx", " "))
    return "filler" if drummed(words) else "strange" if meaningless(words, known) else "ordinary"


def document_lines(docs: DataFrame, doc_id: str, text: str, lang: str | None = None) -> DataFrame:
    """(doc_id, text_key, lang_key, line_no, kind, slots, units, cued, n_words) of all lines that aren't code, tables or logs; lang_key stands for the language's name, one for all texts without.
    cued tells whether a unit has a cue; a text that says one unit over and over is one line of kind drum."""

    kind_of_id = docs.select(F.col(doc_id).alias("doc_id")).schema[0].dataType.simpleString()

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, numbers, kinds, found, sentences, cued, lengths = [], [], [], [], [], [], []
            for i, t in enumerate(batch.column(3).to_pylist()):
                first, said = len(at), []
                for n, (kind, line) in enumerate(text_lines(t)):
                    if kind == "prose":
                        may = may_hold_slot(line)
                        own = units(line, may)
                        said += own
                    elif kind == "page":
                        own, may = [], False
                    else:
                        continue
                    at.append(i)
                    numbers.append(n)
                    kinds.append(kind)
                    found.append(len(slots(line, True)) if may else 0)
                    sentences.append(own)
                    cued.append(any(map(_CUED.__getitem__, own)))
                    lengths.append(sum(u.count(" ") + 1 for u in own))
                if len(said) >= LEAST_WORDS and len(set(said)) == 1 and len(at) > first:
                    kinds[first] = "drum"
            rows = pa.array(at, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(rows), batch.column(1).take(rows), batch.column(2).take(rows), pa.array(numbers, pa.int32()), pa.array(kinds, pa.string()), pa.array(found, pa.int32()), pa.array(sentences, pa.list_(pa.string())), pa.array(cued, pa.bool_()), pa.array(lengths, pa.int32())],
                names=["doc_id", "text_key", "lang_key", "line_no", "kind", "slots", "units", "cued", "n_words"],
            )

    name = F.coalesce(F.lower(F.trim(lang)), F.lit("")) if lang else F.lit("")
    rows = docs.where(F.col(text).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("text_key"), F.xxhash64(name).alias("lang_key"), F.col(text).alias("text"))
    return rows.mapInArrow(take, f"doc_id {kind_of_id}, text_key long, lang_key long, line_no int, kind string, slots int, units array<string>, cued boolean, n_words int")


def _small(table: DataFrame) -> DataFrame:
    """table, marked for broadcast if its rows are few."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def _grown(units: DataFrame, keys: list[str], name: str, as_: str) -> DataFrame:
    """(name, as_) by cluster over the rows (keys, name, support), one group of keys at a time."""

    def grow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, held = None, []
        for batch in batches:
            out = []
            for *key, unit, n in zip(*(batch[k] for k in keys), batch[name], batch["support"]):
                if key != at:
                    out += cluster(held) if held else []
                    at, held = key, []
                held.append((unit, n))
            yield pd.DataFrame(out, columns=[name, as_])
        yield pd.DataFrame(cluster(held) if held else [], columns=[name, as_])

    return units.repartition(*keys).sortWithinPartitions(*keys).select(*keys, name, "support").mapInPandas(grow, f"{name} string, {as_} string")


def mined(said: DataFrame) -> DataFrame:
    """(unit, template, support, lang_a, lang_z) of every distinct masked unit of said (text_key, lang_key, unit)."""
    hashed = said.select(F.xxhash64("unit").alias("u"), "unit", "text_key", "lang_key")
    each = hashed.groupBy("u", "text_key").agg(F.min("lang_key").alias("lang_key"))
    counts = each.groupBy("u").agg(F.count(F.lit(1)).alias("support"), F.min("lang_key").alias("lang_a"), F.max("lang_key").alias("lang_z"))
    support = materialize(hashed.select("u", "unit").distinct().join(counts, "u").drop("u"), "unit-support")
    words = F.split("unit", " ")
    leafed = support.select("unit", "support", F.concat_ws(" ", F.size(words).cast("string"), F.slice(words, 1, DEPTH)).alias("leaf"))
    wide = leafed.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > LEAF_UNITS).select("leaf", F.ceil(F.col("n") / F.lit(LEAF_UNITS)).alias("parts"))
    wide = materialize(wide, "wide-leaves")
    if not wide.limit(1).count():
        grown = _grown(leafed, ["leaf"], "unit", "template")
    else:  # a leaf of many units in parts, then the templates of its parts
        parted = leafed.join(F.broadcast(wide), "leaf", "left").withColumn("part", F.pmod(F.xxhash64("unit"), F.coalesce("parts", F.lit(1))))
        first = materialize(_grown(parted, ["leaf", "part"], "unit", "first"), "parts-of-leaves")
        heads = first.join(leafed, "unit").groupBy("leaf", "first").agg(F.sum("support").alias("support"))
        grown = first.join(_grown(heads, ["leaf"], "first", "template"), "first").select("unit", "template")
    return materialize(grown.join(support, "unit"), "templates")


def _words(c: str):
    return F.regexp_extract_all(F.regexp_replace(c, "4xx", " "), F.lit(r"(\p{L}+(?:['’]\p{L}+)*)"), F.lit(1))


def senseless(said: DataFrame, lines: DataFrame, templates: DataFrame) -> DataFrame:
    """(template) of filler that shows by its words alone."""
    shared = templates.groupBy("template").agg(F.sum("support").alias("n"), F.max_by("unit", F.struct("support", "unit")).alias("exemplar"), F.min("lang_a").alias("lang_a"), F.max("lang_z").alias("lang_z"))
    shared = materialize(shared, "shared-templates")
    own = shared.where(F.col("n") >= SUPPORT).select(F.explode(F.array_distinct(_words("template"))).alias("word")).distinct()
    used = shared.select("exemplar", F.explode(_words("exemplar")).alias("word"))
    known = used.join(own.withColumn("own", F.lit(1)), "word", "left").groupBy("exemplar").agg(F.coalesce(F.sum("own"), F.lit(0)).alias("known"))
    lang = F.when(F.col("lang_a") == F.col("lang_z"), F.col("lang_a"))  # null: said in several languages, so it goes by all texts
    cases = shared.join(known, "exemplar", "left").select("template", "exemplar", "n", lang.alias("lang_key"), F.coalesce("known", F.lit(0)).alias("known"))

    @F.pandas_udf("string")
    def judge(exemplar: pd.Series, known: pd.Series) -> pd.Series:
        return pd.Series([sense(u, k) for u, k in zip(exemplar, known)])

    first = materialize(cases.select("template", "exemplar", "n", "lang_key", "known", judge("exemplar", "known").alias("verdict")), "judged")
    texts = lines.groupBy("text_key").agg(F.min("lang_key").alias("lang_key")).groupBy("lang_key").agg(F.count(F.lit(1)).alias("texts"))
    texts = materialize(texts, "texts-by-language")
    odd = materialize(first.where("verdict = 'strange'").select("template", F.explode(_words("exemplar")).alias("word")).join(own, "word", "left_anti"), "strange-words")
    rare = templates.select("unit", F.explode(F.array_distinct(_words("unit"))).alias("word")).join(_small(odd.select("word").distinct()), "word")
    rare = materialize(rare, "units-of-strange-words")
    uses = said.join(_small(rare), "unit").groupBy("text_key", "word").agg(F.min("lang_key").alias("lang_key")).groupBy("lang_key", "word").agg(F.count(F.lit(1)).alias("uses"))
    heard = uses.join(F.broadcast(texts), "lang_key").where((F.col("uses") >= 2) & (F.col("uses") >= HEARD * F.col("texts"))).select("word").distinct()
    more = odd.join(heard, "word").groupBy("template").agg(F.count(F.lit(1)).alias("heard"))
    clear = (F.col("verdict") == "strange") & (F.col("known") + F.coalesce("heard", F.lit(0)) > 0.34 * F.size(_words("exemplar")))
    judged = first.join(more, "template", "left").select("template", "n", "lang_key", F.when(clear, "neutral").otherwise(F.col("verdict")).alias("verdict"))
    judged = materialize(judged, "judged-again")
    kinds = judged.groupBy("lang_key").agg(*(F.coalesce(F.sum(F.when(F.col("verdict") == v, F.col("n"))), F.lit(0)).alias(v) for v in ("strange", "ordinary")))
    enough = (F.col("texts") >= LEAST_TEXTS) & (F.col("strange") <= MOST_STRANGE * (F.col("strange") + F.col("ordinary")))
    by_lang = texts.join(kinds, "lang_key").select("lang_key", enough.alias("tells"))
    everywhere = texts.agg(F.sum("texts").alias("texts")).crossJoin(kinds.agg(F.sum("strange").alias("strange"), F.sum("ordinary").alias("ordinary")))
    tells = by_lang.unionAll(everywhere.select(F.lit(None).cast("long").alias("lang_key"), enough.alias("tells")))
    at = judged.where("verdict IN ('strange', 'filler')").alias("j").join(F.broadcast(tells.alias("t")), F.expr("j.lang_key <=> t.lang_key"), "left")
    return at.where("verdict = 'filler' OR tells").select("template")


def suspects(templates: DataFrame, cued: DataFrame) -> DataFrame:
    """(template, n, cue, odds, near, sure): the templates that words or company make suspect; near is the share of texts in which it shares a line with a cue. cued: (text_key, unit) of the lines with a cue."""

    @F.pandas_udf("string")
    def cue_of(units: pd.Series) -> pd.Series:
        return pd.Series([cue(u) for u in units], dtype=object)

    close = materialize(templates.select("unit", "template", "support").join(cued.distinct(), "unit"), "units-near-cues")
    hinted = close.groupBy("unit", "template", "support").agg(F.lit(1).alias("one")).select("template", "support", cue_of("unit").alias("cue"))
    hinted = hinted.where("cue IS NOT NULL").groupBy("template", "cue").agg(F.sum("support").alias("s")).groupBy("template").agg(F.max(F.struct("s", "cue")).alias("c"))
    named = templates.groupBy("template").agg(F.sum("support").alias("n")).join(hinted, "template", "left")
    named = materialize(named.select("template", "n", F.when(F.col("c.s") * 2 >= F.col("n"), F.col("c.cue")).alias("cue")), "template-cues")
    # log odds of words, learnt from the texts of templates with a cue against those of the others
    words = materialize(named.select("template", "n", "cue", F.explode(F.array_distinct(_words("template"))).alias("word")), "template-words")
    texts = lambda when, name: F.coalesce(F.sum(F.when(when, F.col("n"))), F.lit(0)).alias(name)
    logs = materialize(words.groupBy("word").agg(texts(F.col("cue").isNotNull(), "b"), texts(F.col("cue").isNull(), "o")), "word-texts")
    of = named.agg(texts(F.col("cue").isNotNull(), "b"), texts(F.col("cue").isNull(), "o")).first()
    sums = logs.agg(F.sum("b").alias("b"), F.sum("o").alias("o"), F.count(F.lit(1)).alias("v")).first()
    b, o, v = float(sums["b"] or 0), float(sums["o"] or 0), float(max(1, sums["v"]))
    x = F.log((F.col("b") + 0.5) / F.lit(b + v / 2)) - F.log((F.col("o") + 0.5) / F.lit(o + v / 2))
    logs = logs.select("word", F.when(F.col("b") > 0, x).otherwise(F.least(x, F.lit(0.0))).alias("x"))  # a word no cued template has says nothing for them
    prior = math.log((float(of["b"]) + 0.5) / (float(of["o"]) + 0.5))
    odds = words.join(logs, "word").groupBy("template").agg((F.sum("x") + F.lit(prior)).alias("odds"))
    near = close.groupBy("template", "text_key").agg(F.lit(1).alias("one")).groupBy("template").agg(F.count(F.lit(1)).alias("near"))
    got = named.join(odds, "template", "left").join(near, "template", "left")
    return got.where((F.col("cue").isNotNull()) | (F.col("odds") > 0) | (F.col("near") >= SUSPECT * F.col("n"))).select("template", "n", "cue", F.coalesce("odds", F.lit(0.0)).alias("odds"), F.coalesce(F.col("near") / (F.col("n") + FEW), F.lit(0.0)).alias("sure"))


def residue(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str | None = None) -> DataFrame:
    """(doc_id, reason, n_lines) of the documents with residue; reason is slot, page, error, notice or filler. lang names the column of the texts' language, if there is one."""
    lines = materialize(document_lines(docs, doc_id, text, lang), "document-lines")
    prose = lines.where("kind != 'page'")
    said = prose.select("text_key", "lang_key", F.explode("units").alias("unit")).where("unit != ''")
    templates = mined(said)
    odd = materialize(senseless(said, prose, templates), "senseless")
    cued = prose.where("cued").select("text_key", F.explode("units").alias("unit"))
    held = materialize(suspects(templates, cued), "suspects")
    both = held.join(odd.withColumn("senseless", F.lit(True)), "template", "full").select("template", "n", "cue", "odds", "sure", F.coalesce("senseless", F.lit(False)).alias("senseless"))
    wanted = materialize(templates.select("unit", "template").join(both, "template"), "suspect-units")
    placed = prose.select("doc_id", "text_key", "line_no", "n_words", F.explode("units").alias("unit"))
    hits = materialize(placed.join(_small(wanted), "unit").withColumn("words", F.size(F.split("unit", " "))), "suspect-lines")
    line = Window.partitionBy("doc_id", "line_no")
    held = F.when(F.col("senseless") | F.col("cue").isNotNull() | (F.col("sure") >= COMPANY), F.col("words")).otherwise(0)
    own = Window.partitionBy("doc_id", "line_no", "template")
    seen = hits.withColumn("held", held).withColumn("rest", F.col("n_words") - F.sum("words").over(own)).withColumn("held_rest", F.sum("held").over(line) - F.sum("held").over(own))
    seen = seen.withColumn("n_cued", F.count("cue").over(line)).withColumn("neighbour", F.max("cue").over(line))
    # ordinary words are more than half of the other words, and weigh against its own: a menu beside a message is no running text
    running = (F.col("rest") > 0) & (2 * F.col("held_rest") < F.col("rest")) & (2 * (F.col("rest") - F.col("held_rest")) >= F.col("n_words") - F.col("rest"))
    with_cued = (F.col("rest") > 0) & ~running & (F.col("n_cued") > F.when(F.col("cue").isNotNull(), 1).otherwise(0))
    texts = seen.where("NOT senseless").groupBy("template", "cue", "odds", "n", "text_key").agg(F.max(running.cast("int")).alias("running"), F.max(with_cued.cast("int")).alias("company"), F.max(F.when(with_cued, F.col("neighbour"))).alias("neighbour"))
    kept = texts.groupBy("template", "cue", "odds", "n").agg(F.sum("running").alias("running"), F.sum("company").alias("company"), F.mode("neighbour", True).alias("neighbour"))
    led = (F.col("company") > F.col("running")) & ((F.col("company") >= COMPANY * F.col("n")) | (F.col("odds") > 0))
    alone = (F.col("running") == 0) & (F.col("company") == 0) & (F.col("odds") > 0)
    verdict = F.when(F.col("cue").isNotNull(), F.when(2 * F.col("running") <= F.col("n"), F.col("cue"))).when(led, F.col("neighbour")).when(alone, F.lit("error"))
    bad = kept.select("template", verdict.alias("reason")).where("reason IS NOT NULL").unionByName(odd.select("template", F.lit("filler").alias("reason"))).groupBy("template").agg(F.max("reason").alias("reason"))
    bad = materialize(bad, "residue-templates")
    share = hits.join(_small(bad), "template").groupBy("doc_id", "line_no", "n_words").agg(F.sum("words").alias("words"), F.max("reason").alias("reason"))
    stands = share.where(F.col("words") >= STANDS * F.col("n_words")).select("doc_id", "line_no", "reason")
    open_slots = lines.where("slots > 0").select("doc_id", "line_no", F.lit("slot").alias("reason"))
    pages = lines.where("kind = 'page'").select("doc_id", "line_no", F.lit("page").alias("reason"))
    drums = lines.where("kind = 'drum'").select("doc_id", "line_no", F.lit("filler").alias("reason"))
    return open_slots.unionByName(pages).unionByName(drums).unionByName(stands).groupBy("doc_id", "reason").agg(F.count_distinct("line_no").alias("n_lines"))
