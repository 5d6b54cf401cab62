"""Template residue, filler and error text instead of content.

Numbers, addresses and dates of a block are masked; blocks with the same
normalised text form a group across all sources.  A group is a case if its text
holds a phrase of failure, of a script notice or of filler and it recurs, with
different texts around it, on several sources; what people write about such
things does not recur as a whole block.  A body that holds hardly anything but
such a phrase, or nothing but one text of many sources, is a case as well.
Unfilled slots, leaked program values and pseudo-Latin are found by placeholder
rules.  Listings (pre) are not looked at.
"""

from __future__ import annotations

import re

import ahocorasick

# --- fixed values: phrases of messages, slots and filler ------------------------------------------

#: Phrases of failure, denial, maintenance, faults and script notices.
PHRASES = [
    r"\b(?:page|file|document|site|resource|article|item|address) (?:was |is )?(?:not found|gone)\b", r"\bnot found\b", r"\b(?:does not|doesn't) exist\b", r"\b(?:could not|couldn't|cannot|can not|can't|can’t|could n't) (?:be )?(?:find|found|reach(?:ed)?|open(?:ed)?|load(?:ed)?|display(?:ed)?|connect|complete|process)\b", r"\bno longer available\b", r"\bhas been (?:moved|removed|deleted)\b",
    r"\bforbidden\b", r"\b(?:access|permission) denied\b", r"\b(?:do not|don't) have (?:permission|access)\b", r"\bnot authori[sz]ed\b", r"\bhas expired\b", r"\btoo many requests\b", r"\bchecking (?:your|if the site) (?:connection|browser)?", r"^just a moment\b", r"^one moment\b", r"^please wait\b",
    r"^error(?: code)?:? #", r"^(?:http )?# (?:error\b.*)?$", r"\b(?:internal|unexpected) (?:server )?(?:error|condition)\b", r"\bservice (?:is )?(?:temporarily )?unavailable\b", r"\b(?:bad gateway|gateway time-?out)\b", r"\bsomething went wrong\b", r"\b(?:down for|under|scheduled) maintenance\b", r"\berror establishing\b", r"\ban? (?:\w+ )?error (?:has )?occurred\b", r"\breported an error\b",
    r"^(?:php )?(?:fatal|parse|syntax|type|reference|value|key|uncaught)? ?error:", r"^warning: \w+\(", r"^traceback \(most recent call", r"\b[\w.]+(?:exception|error) at [\w.$]+\(", r"^(?:uncaught )?\w*(?:error|exception): ",
    r"\b(?:enable|turn on|activate|allow|needs?|requires?) (?:javascript|scripts)\b", r"\b(?:javascript|scripts?) (?:is|are) (?:disabled|turned off|required|blocked)\b", r"\bbrowser may block\b", r"^loading…",
    r"\bnicht (?:gefunden|erreichbar|verfügbar|vorhanden)\b", r"\bgibt es nicht\b", r"\bzugriff verweigert\b", r"\bkeine berechtigung\b", r"\b(?:interner|unerwarteter) (?:fehler|serverfehler)\b", r"^fehler #", r"\bwartungsarbeiten\b", r"\b(?:aktivieren sie|braucht) (?:javascript|skripte)\b", r"\bjavascript ist deaktiviert\b",
    r"\bno (?:encontrad[ao]|existe|disponible)\b", r"\b(?:acceso denegado|error interno)\b", r"\ben mantenimiento\b", r"\b(?:active|habilite|necesita|requiere) (?:javascript|scripts)\b", r"^error #",
    r"\b(?:introuvable|non trouvée?)\b", r"\bn['’]existe (?:pas|plus)\b", r"\baccès (?:refusé|interdit)\b", r"\berreur (?:interne|#)", r"\ben maintenance\b", r"\b(?:activer|activez|besoin de|nécessite) (?:javascript|scripts|des scripts)\b",
    r"\bне (?:знайдено|існує|знайдена)\b", r"\bтакої (?:адреси|сторінки) немає\b", r"\bдоступ заборонено\b", r"\bвнутрішня помилка\b", r"^помилка #", r"\bтехнічному обслуговуванні\b", r"\b(?:увімкніть|потрібен|потрібні) (?:javascript|скрипти)\b",
]
#: Phrases of filler.
FILLERS = [
    r"\b(?:your|title|heading|text|description|content|name) (?:\w+ )?goes here\b", r"^(?:your|insert|add|enter|put) (?:\w+ )*here$", r"\bsample (?:text|paragraph|content|title)\b", r"\bplaceholder\b", r"\bdummy text\b", r"\breplace (?:it|this|me) with\b", r"^coming soon\b", r"^under construction\b", r"^todo\b", r"^tbd\b",
    r"\b(?:beispiel|blind|platzhalter)text\b", r"^(?:hier|überschrift|titel|text|beschreibung) (?:\w+ )*(?:text|hier|titel|überschrift|beschreibung)\b", r"^demnächst\b",
    r"\btexto de (?:ejemplo|muestra|relleno)\b", r"^(?:aquí )?(?:va |irá )?su (?:texto|título)\b", r"^próximamente\b",
    r"\btexte (?:d['’]exemple|de remplissage)\b", r"^(?:ici )?(?:\w+ )*votre (?:texte|titre)\b", r"^bientôt\b",
    r"\bприклад тексту\b", r"^тут (?:\w+ )*(?:текст|заголовок|опис)\b", r"^ваш текст\b", r"^(?:незабаром|скоро)\b",
]
#: Slots of template languages.
SLOTS = [
    r"\{\{[^{}\n]{1,60}\}\}", r"\{%[^%\n]{1,60}%\}", r"<%=?[^%\n]{1,60}%>", r"<\?=?[^?\n]{1,60}\?>", r"[$#]\{[^{}\n]{1,60}\}",
    r"%%[A-Za-z_][\w.]{1,40}%%(?!\w)", r"%\([\w.]{1,40}\)[sd]", r"(?<!\w)__[A-Za-z][\w.]{0,40}?__(?!\w)", r"@Model\.[\w.]+", r"\[\[[\w. ]{1,40}\]\]?", r"\[[\w.]{1,40}-HERE\]", r"\[object Object\]",
]
#: What prose holds too, and is a slot only with others beside it.
WEAK_SLOTS = [r"(?<![\w{$#%])\{[A-Za-z_][\w.]{0,40}\}", r"(?<!%)%[A-Za-z_][\w.]{1,40}%(?![\w%])", r"(?<![\w$])\$[A-Za-z_][\w.]*"]
#: Values that programs print when a slot is empty.
VALUES = r"(?<![\w’'-])(?:undefined|NaN|null)(?![\w’'-])"
#: A value that is a name or a word of prose as well.
NAMELIKE = r"(?<![\w’'-])None(?![\w’'-])"
LOREM = (
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud "
    "nostra exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis dui aute irure in reprehenderit voluptate velit vela esse cillum eu fugiat nulla pariatur "
    "excepteur sint occaecat cupidatat non nolit proident sunt culpa qui officia deserunt mollit anim id est laborum quam turpis turis"
)
# --- end of fixed values --------------------------------------------------------------------------

#: Sources, and different surroundings, on which a text with a phrase must recur to be a message.
WIDE_SOURCES = 3
#: Sources on which a text without a phrase must recur as the only text of its body.
ALONE_SOURCES = 10
#: Words up to which a body counts as holding hardly anything beside a phrase.
THIN_WORDS = 30

_LOREM = {w[:k] for w in LOREM.split() for k in range(min(4, len(w)), len(w) + 1)}
_BEGIN = re.compile(r"[\s.!?…:;,–—-]*+(?:" + "|".join(f"(?:{p[1:]})" for p in PHRASES + FILLERS if p.startswith("^")).replace("#", r"\d+") + ")")
_WITHIN = re.compile("|".join(f"(?:{p})" for p in PHRASES + FILLERS if not p.startswith("^")).replace("#", r"\d+"))
#: Every phrase that may stand within a text holds one of these.
_HINTS = (
    "found", "gone", "exist", "could", "can't", "can’t", "cannot", "can not", "no longer", "has been", "forbidden", "denied", "have permission", "don't have", "have access", "not author", "expired", "too many", "checking", "internal", "unexpected", "unavailable", "gateway", "went wrong", "maintenance", "error", "exception", "javascript", "script", "browser may",
    "nicht ", "gibt es", "verweigert", "berechtigung", "fehler", "wartung", "skripte", "encontrad", "no existe", "no disponible", "denegado", "mantenimiento", "introuvable", "non trouv", "existe p", "refusé", "interdit", "erreur", "не ", "немає", "заборонено", "помилка", "обслуговуванні", "скрипти",
    "goes here", "sample ", "placeholder", "dummy", "replace ", "beispieltext", "blindtext", "platzhaltertext", "texto de", "texte d", "приклад",
)
_SLOT = re.compile("|".join(SLOTS))
_WEAK = re.compile("|".join([*WEAK_SLOTS, VALUES, NAMELIKE]))
_NAMELIKE = re.compile(NAMELIKE)
#: Every pseudo-Latin text holds one of these, and every slot or value one of those.
_LOREM_HINTS = ("lorem", "ipsum", "dolor", "amet", "elit", "tempor", "magna", "aliqua", "veniam", "venia", "quis", "nulla", "irur", "volup", "sint", "enim", "labor")
_SLOT_HINTS = ("{", "%", "<", "@", "$", "[", "__", "undefined", "nan", "null", "none")
_WORD = re.compile(r"[^\W\d_]+")
_DATE = re.compile(r"\b\d{4}-\d\d-\d\d(?:[T ]\d\d:\d\d(?::\d\d)?)?\b|\b\d{1,2}[./]\d{1,2}[./]\d{2,4}\b")
_ADDRESS = re.compile(r"\bhttps?://\S+|(?<![\w.+-])[\w.+-]++@[\w-]+\.[\w.]+|\b\d{1,3}(?:\.\d{1,3}){3}\b")
_NUMBER = re.compile(r"\d+")
_HINTED = ahocorasick.Automaton()
_PHRASE_BIT, _LOREM_BIT, _SLOT_BIT = 1, 2, 4
for _hints, _bit in ((_HINTS, _PHRASE_BIT), (_LOREM_HINTS, _LOREM_BIT), (_SLOT_HINTS, _SLOT_BIT)):
    for _hint in _hints:
        _HINTED.add_word(_hint, _HINTED.get(_hint, 0) | _bit)
_HINTED.make_automaton()
_EDGE = re.compile(r"^[\s.!?…:;,–—-]+|(?<![\s.!?:;,–—-])[\s.!?:;,–—-]+$")


def masked(text: str) -> str:
    """Text with addresses, dates and numbers masked, in lower case, without outer punctuation."""
    if "@" in text or "://" in text or "." in text:
        text = _ADDRESS.sub("@", text)
    if _NUMBER.search(text):
        text = _NUMBER.sub("#", _DATE.sub("#", text))
    return _EDGE.sub("", text.lower())


def hints(low: str) -> int:
    """Which rules may apply to a lower-case text, as bits."""
    bits = 0
    for _, bit in _HINTED.iter(low):
        bits |= bit
    return bits


def is_lorem(low: str) -> bool:
    """Five words or more, most of them of the usual pseudo-Latin."""
    words = _WORD.findall(low)
    return len(words) >= 5 and sum(w in _LOREM for w in words) * 10 >= len(words) * 6


def has_slots(texts: list[str]) -> bool:
    """An unfilled slot or a leaked program value in any of the texts of a body.

    A value counts where prose has none: as the beginning of a text, twice in a
    row, or more than once in a body.  Shapes that prose has too (``$NAME``,
    ``{name}``) count from two different ones on, ``None`` only beside others.
    """
    weak: list[str] = []
    for t in texts:
        if _SLOT.search(t):
            return True
        for m in _WEAK.finditer(t):
            x = m.group()
            if x in ("undefined", "null", "NaN"):
                if (m.start() == 0 and x != "NaN" and t != x) or t[m.end() :].startswith(" " + x):
                    return True
            weak.append(x)
    values = [x for x in weak if x in ("undefined", "null", "NaN")]
    return len(values) > 1 or len(set(weak)) > 1


def is_repetition(low: str) -> bool:
    """Three words or more, all the same, or four of which at most half are different and the first comes again."""
    first = low.split(" ", 1)[0]
    if not first.isalpha() or low.count(first) < 3 and low.count(first) * 2 < low.count(" "):
        return False
    words = low.rstrip(" .!?…").split()
    different = len(set(words))
    return len(words) >= 3 and (different == 1 or different * 2 <= len(words)) and all(w.isalpha() for w in words)


def has_phrase(low: str, bits: int | None = None) -> bool:
    """A lower-case text, of any length, with a phrase of a message or of filler."""
    if _BEGIN.match(low) or is_repetition(low):
        return True
    return bool((hints(low) if bits is None else bits) & _PHRASE_BIT) and _WITHIN.search(low) is not None


def judge(texts: list[str], empty: bool) -> tuple[str | None, list[str]]:
    """What rules say of a body's texts outside listings, and its texts with phrases, masked, that recurrence decides.

    ``slot``, ``filler``, or ``message`` for a body of a phrase and hardly
    anything else, or of one text that begins with a phrase; ``empty`` says that no text was found to be content.
    """
    slots, phrases, n_words = [], [], 0
    for t in texts:
        low = t.lower()
        bits = hints(low)
        if bits & _LOREM_BIT and is_lorem(low):
            return "filler", []
        if bits & _SLOT_BIT:
            slots.append(t)
        if has_phrase(low, bits):
            phrases.append(t)
        n_words += t.count(" ") + 1
    if slots and has_slots(slots):
        return "slot", []
    if phrases and (empty or n_words <= THIN_WORDS or (len(texts) == 1 and _BEGIN.match(texts[0].lower()))):
        return "message", []
    return None, [masked(t) for t in dict.fromkeys(phrases)]
