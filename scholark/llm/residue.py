"""Template residue, filler, error pages and script notices in texts.

Two tests, each on the whole text. A template slot is found by the grammar of its delimiter and counts unless its
surroundings show that it is quoted, discussed or code. A text as a whole counts if, headings, navigation and footers
aside, filler and messages make up (nearly) all of its words; content beside them takes that density away.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Share of a body's words that messages and filler must cover.
DENSITY = 0.8
#: Share of a body's words that must be filler Latin, and of different words under which a body only repeats itself.
LATIN_SHARE, DIFFERENT_SHARE = 0.7, 0.34

_NAME = r"[\p{L}_][\p{L}\p{N}_.\-]*"
_CAPS = r"[A-Z][A-Z0-9]*(?:[_ ][A-Z0-9]+)*"
_WORDS = r"\p{L}[\p{L}_\-]*(?:\s+\p{L}[\p{L}_\-]*){0,4}"
#: One grammar for each kind of delimiter. A slot names one thing; what names two or holds an expression is no slot.
SLOTS = {
    "double brace": rf"\{{\{{\s*[#/^>&]?\s*{_NAME}(?:\s*\|\s*[\p{{L}}_]+(?:[:(][^{{}}]*)?)*\s*\}}\}}",
    "statement": r"\{%-?\s*(?:for|endfor|if|endif|else|elif|block|endblock|include|extends|set)\b[^{}%]*-?%\}",
    "angle percent": r"<%[=\-]?\s*[^<>%\n]{1,80}?\s*-?%>",
    "dollar brace": rf"(?<![\\\p{{L}}\p{{N}}])\$\{{\s*{_NAME}\s*\}}",
    "brace dollar": rf"\{{\$\s*{_NAME}\s*\}}",
    "hash brace": rf"#\{{\s*{_NAME}\s*\}}",
    "brace": r"(?<![\\$#{%_^\p{L}\p{N}])\{(?:[a-z]+(?:_[a-z]+)+|[a-z]{3,}|[A-Z]{3,}(?:_[A-Z]+)*)\}(?!\})",
    "percent": r"(?<![\p{L}\p{N}%])%[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)*%(?![\p{L}\p{N}%])",
    "percent name": r"(?<!%)%\([a-z_][a-z0-9_]*\)[sdifr]\b",
    "square pair": rf"\[\[\s*{_CAPS}\s*\]\]",
    "angle pair": rf"<<\s*{_CAPS}\s*>>",
    "angle order": rf"<(?:(?i:insert|enter|your|add|put|ins[ée]rer|inserir|insertar|einf[üu]gen))\s+{_WORDS}\s*>",
    "angle entity": r"&lt;\s*\p{L}[\p{L}_\-]*(?:\s+\p{L}[\p{L}_\-]*){0,4}\s*&gt;",
    "square order": rf"\[\s*(?:(?i:insert|enter|add|put|fill in|type|ins[ée]rer|inserir|insertar|вставить|вставьте))\s+[^\[\]\n]{{1,80}}\]",
    "square order after": rf"\[\s*{_WORDS}\s+(?:(?i:einf[üu]gen|eintragen|eingeben))\s*\]",
    "square yours": rf"\[\s*(?i:your|ihr|ihre|votre|su|seu)\s+{_WORDS}(?:\s+(?i:here|hier|ici|aqu[íi]|aqui))?\s*\]",
    "square to do": r"\[\s*(?:TODO|TBD|TBC|TK|FIXME)\b[^\[\]\n]{0,120}\]",
    "at pair": rf"(?<![\w@])@@\s*{_NAME}\s*@@",
    "hash pair": r"(?<![\w#])##[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)*##",
    "underscore pair": r"(?<![\w])__[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)*__(?![\w])",
    "suffix": r"\b[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)*_PLACEHOLDER\b",
    "goes here": rf"\(\s*{_WORDS}\s+(?i:goes|go|comes)\s+(?i:here)\s*\)",
    "bare mark": r"(?<![\w\[{<(\"'“‘«`/\-])(?:TBD|TBA|TBC|XXX+)(?![\w\]}>)\"'”’»`/\-])",
    "masked number": r"(?<=\p{L}[ \u00a0])(?:\?{2,}(?:[.,]\?+)?|X+[.,]X+)(?=[ \u00a0]?(?:\p{Ll}|%))",
    "marked block": r"<!--\s*(?:BEGIN|START|LOOP|END)\s+[\w ]{1,40}-->",
}
_SLOT = regex.compile("|".join(f"(?:{p})" for p in SLOTS.values()))
#: What any slot must hold; most texts don't, and are not searched further.
_MARKS = ("{", "[", "<", "@@", "%", "##", "__", "_PLACEHOLDER", "&lt;", "TBD", "TBA", "TBC", "XX", "X.X", "X,X", "??")
_GOES_HERE = regex.compile(r"(?i)\b(?:goes|go|comes)\s+here")
_FENCE = regex.compile(r"```.*?(?:```|\Z)|~~~\n.*?(?:\n~~~|\Z)|(?m:^(?: {4}|\t)[^\n]*$)|<(code|pre)\b[^>]*>.*?</\1>|`[^`\n]{1,200}`", regex.S)
_MATHS = regex.compile(r"\$[^$\n]{1,200}\$|\\\([^\n]{1,200}?\\\)|\\[a-zA-Z]+\{[^{}\n]*\}")
#: Words by which a sentence talks about slots instead of holding one.
_TALK = regex.compile(r"(?i)\b(?:placeholders?|slots?|markers?|template (?:engines?|languages?|syntax)|syntax|delimiters?|parsers?|strings? (?:such as|like)|mustache|unfilled|moustache|variables?|escap\w+|tokens? (?:such as|like))\b")
_QUOTES = [("\"", "\""), ("“", "”"), ("„", "“"), ("«", "»"), ("‘", "’"), ("`", "`")]
_SENTENCE = regex.compile(r"[^\n.!?]*(?:[.!?](?!\s|$)[^\n.!?]*)*[.!?]?")

# The words of the usual filler Latin.
LATIN = frozenset(
    """lorem ipsum dolor sit amet consectetur consectetuer adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna
    aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in
    reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui
    officia deserunt mollit anim id est laborum donec nunc diam morbi erat rutrum lacus cursus vitae augue porta felis pretium libero
    ornare massa ligula mauris vestibulum pellentesque vel at ac nec integer nam praesent pharetra tellus urna odio justo""".split()
)

#: Characters of a unit beyond which it can't be frame.
LONGEST_FRAME = 400
#: Lines and sentences that frame a page: navigation, footers and fixed headings.
_FRAME = regex.compile(
    r"""(?ix)^(?: (?:skip\s+to\s+(?:main\s+)?content|menu|home|back|help|login|log\s+in|search|contact|imprint|read\s+more|share\s+this\s+\w+|next|previous|top|print)
      | [^\n|>]{1,30}(?:\s*[|>›»/]\s*[^\n|>]{1,30}){1,8}
      | (?:©|\(c\)|copyright\b)[^\n]{0,80}
      | (?:proxy|nginx|apache|server|cloud\w*|squid)\s*/\s*[\d.]+
      | (?:incident|request|ref(?:erence)?|ray|trace|error)?\s*(?:id|no|code)?[:\s]*\(?(?:code\s+)?[0-9a-f\-]{2,40}\)?
      | \(\s*code\s+\d+\s*\) | :-?[()] | abstract | about\s+the\s+author | keywords? | summary | heading\s+\w+ | most\s+cited\s+first )\W*$"""
)
#: Messages of servers and programs: an error, a refusal or a wall before the content.
_ERROR = regex.compile(
    r"""(?ix)
    \b(?:http(?:/\d\.\d)?\s+)?(?:status\s+|error\s+|fehler\s+|erreur\s+|erro\s+|ошибка\s+)?(?:4\d\d|5\d\d)\b[\s:\-–—.)]*(?:not\s+found|bad\s+(?:gateway|request)|forbidden|unauthori[sz]ed|gone|service\s+unavailable|gateway\s+time-?out|internal\s+server\s+error|too\s+many\s+requests|request\s+time-?out|.{0,60}could\s+not\s+be\s+completed)
    | \b(?:http\s+)?(?:status|error|fehler|erreur|erro|ошибка)\s+(?:code\s+)?\d{3}\b
    | \bpage\s+(?:you\s+\w+\s+(?:for\s+)?)?(?:was\s+|is\s+|could\s+|can)?not\s+(?:be\s+)?(?:found|exist) | \b(?:could|can)(?:not|\s+not|n['’]t)\s+be\s+(?:found|loaded|reached|displayed|opened|completed|processed)
    | \bhas\s+(?:been\s+)?moved\s+or\s+no\s+longer\s+exists | \bno\s+longer\s+exists
    | \bgo\s+back\s+to\s+the\s+\w+ | \breturn\s+to\s+the\s+(?:home|start|search)\w*
    | \b(?:internal|interner)\s+server\s*-?(?:error|fehler) | \bserverfehler\b | \berror\s+del\s+servidor | \berreur\s+(?:interne\s+)?du\s+serveur | \berro\s+(?:interno\s+)?do\s+servidor
    | \bno\s+se\s+pudo\s+(?:cargar|abrir|encontrar) | \bp[áa]gina\s+n[ãa]?o?\s*(?:no\s+)?(?:encontrada|existe) | \bvolte\s+ao\s+in[íi]cio | \bvuelva\s+al\s+inicio
    | \bseite\s+(?:wurde\s+)?nicht\s+gefunden | \bexistiert\s+nicht\s+mehr | \bbitte\s+versuchen\s+sie\s+es\s+\w*\s*(?:noch\s+einmal|sp[äa]ter|erneut)
    | \bacc[èe]s\s+(?:refus[ée]|interdit) | \bpas\s+les\s+droits | \bpage\s+(?:introuvable|non\s+trouv[ée]e) | \bacceso\s+(?:denegado|prohibido) | \bacesso\s+negado | \bzugriff\s+verweigert
    | \bстраница\s+не\s+найдена | \bдоступ\s+(?:запрещ[её]н|закрыт) | \bошибка\s+(?:сервера|\d{3}) | \bне\s+удалось\s+загрузить
    | 页面不存在 | 找不到(?:页面|该页) | 服务器(?:内部)?错误 | 拒绝访问 | 无法(?:加载|显示|访问) | 请返回(?:首页|主页)
    | \baccess\s+(?:is\s+|was\s+)?denied | \b(?:do\s+not|don['’]t)\s+have\s+(?:the\s+)?(?:permission|access|rights) | \bpermission\s+denied | \bnot\s+(?:allowed|authori[sz]ed)\s+to\s+(?:view|see|open|access)
    | \btoo\s+many\s+requests | \bslow\s+down\s+and\s+retry | \bretry\s+(?:after|in)\s+\d+ | \btry\s+again\s+(?:in\s+\d+|later|soon) | \brate\s+limit
    | \bdown\s+for\s+(?:scheduled\s+)?maintenance | \bunder\s+maintenance | \bwill\s+be\s+back\s+(?:on|in|at|soon|shortly) | \btemporarily\s+unavailable
    | \boops\b | \bsomething\s+went\s+wrong | \ban?\s+(?:unexpected\s+)?error\s+(?:has\s+)?occurred | \bwe['’]?re\s+sorry\b.{0,40}(?:error|wrong|unavailable)
    | \bconnection\s+(?:timed\s+out|refused|reset) | \bcould\s+not\s+connect\s+to | \btime(?:d)?[\s\-]?out\b.{0,20}$ | \bupstream\s+(?:timeout|error)
    | traceback\s+\(most\s+recent\s+call | ^\s*file\s+"[^"\n]+",\s+line\s+\d+ | \b\w*(?:error|exception)(?:\s*:|$) | \b(?:java|org|com)\.[\w.]+(?:exception|error)\b | ^\s*at\s+[\w.$]+\([\w.]+:\d+\)
    | \{\s*"(?:status|error|code|message)"\s*:.{0,200}\}
    | \b(?:please\s+)?(?:sign|log)\s+in\s+(?:again\s+)?to\s+(?:read|view|see|continue) | \bsession\s+(?:has\s+)?(?:expired|timed\s+out|ended)
    | \bverify\s+(?:that\s+)?you(?:\s+a|['’])re\s+(?:a\s+)?(?:person|human|not\s+a\s+robot) | \btick\s+the\s+box\b | \bcomplete\s+the\s+captcha | \bare\s+you\s+a\s+robot | \bunusual\s+traffic
    | \b(?:i['’]m\s+sorry|i\s+am\s+sorry|sorry)[,.]?\s+(?:but\s+)?i\s+(?:can(?:not|['’]t)|am\s+(?:not\s+able|unable)) | \bas\s+an?\s+(?:ai|language\s+model)\b | \bi\s+can(?:not|['’]t)\s+(?:help|assist|comply|fulfil)
    """
)
#: Notices that scripts (or cookies) are needed.
_SCRIPT = regex.compile(
    r"""(?ix)
    \b(?:enable|activate|turn\s+on|switch\s+on|allow|permit|require[sd]?|needs?|without|disabled?|blocks?|blocked|supports?|activez?|activer|ativar|ative|activar|active|habilit\w+|aktivier\w+|ben[öo]tigt|blockiert|unterst[üu]tzt|require)\b.{0,60}\b(?:java\s?script|js|scripts?|scripting|skripte?)\b
    | \b(?:java\s?script|js|scripts?|scripting|skripte?)\b.{0,60}\b(?:is|are|must|needs?|required?|disabled|enabled|blocked|switched|turned|off|on|aktivier\w+|deaktiviert|desactivado|d[ée]sactiv[ée]|desativado|erforderlich|needed|blockiert)\b
    | \b(?:script|javascript)-(?:capable|enabled)\s+browser
    | включите\s+(?:javascript|скрипты|сценарии) | (?:javascript|скрипты)\s+(?:отключ|выключ)\p{L}* | 请?(?:启用|开启|打开)\s*(?:javascript|脚本) | (?:javascript|脚本)\s*(?:已禁用|被禁用|未启用)
    | ^\s*turn\s+it\s+on\s+and\s+reload | \bupdate\s+yours\s+or\s+change | \bif\s+nothing\s+happens\b | \bchange\s+its\s+security\s+settings | \breload\s+(?:the|this)\s+page\W*$ | \bcookies\s+in\s+(?:the\s+settings\s+of\s+)?your\s+browser | ^\s*loading\W*$ | \bplease\s+wait\W*$ | ^\s*(?:and\s+)?try\s+once\s+more\W*$"""
)
#: Words put where content is still to come.
_FILLER = regex.compile(
    r"""(?ix)
    \b(?:dummy|placeholder|sample|filler|example|provisional)\s+(?:text|paragraph|copy|content|abstract)\b | \byour\s+(?:text|abstract|title|content|summary|name)\s+(?:goes\s+)?here\b
    | \b(?:body\s+)?(?:copy|text|content|abstract|title)\s+(?:goes|comes|to\s+go)\s+(?:in\s+this\s+box|here)\b | \bclick\s+(?:here\s+)?to\s+(?:add|edit|enter)\b | \btype\s+or\s+paste\b | \b(?:replace|overwrite)\s+this\s+(?:wording|text|paragraph|sentence)\b
    | \bcoming\s+soon\b | \b(?:content|text|abstract|details?|more)\s+to\s+(?:follow|come)\b | \b(?:says|means)\s+nothing\s+and\s+will\s+be\b | \bunder\s+construction\b | \bto\s+be\s+(?:added|written|announced|supplied|filled\s+in)\b
    | \bblindtext\b | \bplatzhalter(?:text)?\b | \bhier\s+steht\s+(?:sp(?:ä|ae|a)ter|bald)\b | \bf[üu]lltext\b | \btexte\s+(?:provisoire|de\s+remplissage|factice)\b | \bsera\s+remplac[ée]\b | \btexto\s+(?:de\s+(?:relleno|ejemplo|muestra|exemplo)|provis[óo]rio|provisional|aqu[íi])\b | \bser[áa]\s+(?:reemplazado|substitu[íi]do)\b
    | \bтекст(?:-|\s+)заполнитель\b | \bздесь\s+(?:будет|появится)\s+текст\b | \bрыба-текст\b | 此处(?:填写|输入|插入) | 占位(?:符|文字|文本) | 示例文字 | 内容待(?:补充|定|添加)"""
)
# Words without one of which a unit (without Han signs or a server's signs) holds no message of a kind.
SCRIPT_CUES = frozenset(
    """javascript java js script scripts scripting skripte скрипты сценарии loading wait reload once yours happens cookies settings
    script-capable javascript-enabled script-enabled javascript-capable""".split()
)
ERROR_CUES = frozenset(
    """java found exist exists denied forbidden unauthorized gateway unavailable requests request timeout time-out timed out refused reset status error fehler
    erreur erro ошибка server serverfehler servidor serveur moved back return pudo página pagina volte vuelva seite existiert versuchen accès acces droits
    introuvable trouvée acceso acesso zugriff страница доступ удалось access permission authorized authorised allowed slow retry again rate maintenance
    temporarily oops wrong occurred sorry connect connection upstream traceback file sign log session verify captcha robot traffic tick box ai cannot
    can't can’t couldn't couldn’t loaded reached displayed opened completed processed""".split()
)
FILLER_CUES = frozenset(
    """dummy placeholder sample filler example provisional your copy text content abstract title click type paste replace overwrite coming follow come nothing
    construction added written announced supplied filled blindtext platzhalter platzhaltertext steht fülltext fulltext texte texto remplace remplacé será sera
    текст заполнитель рыба-текст""".split()
)
_MESSAGES = (("script", SCRIPT_CUES, _SCRIPT), ("error", ERROR_CUES, _ERROR), ("filler", FILLER_CUES, _FILLER))
_CODE = regex.compile(r"[\p{Han}{]|\b[45]\d\d\b|\w(?:Error|Exception)\b|^\s*at\s")
_KEYBOARD = regex.compile(r"(?i)^(?:(\p{L})\1+|(?:blah?|bla|foo|bar|baz|test|etc|qwer\w*|asdf\w*|jkl\w*|zxcv\w*|qux|abc|xyz|dummy|foobar|\d+|abstract|title|text)\W*)$")
_QUOTED = regex.compile(r"“[^”\n]*”|\"[^\"\n{}:]*\"(?!\s*[:,}])|«[^»\n]*»|„[^“\n]*“")
_NOT_BREAK = regex.compile(r"[^\n]")
_SPLIT = regex.compile(r"(?<=[.!?。！？])\s+|(?<=[。！？])")
_STOP = regex.compile(r"[.!?。]$")
_WORD = regex.compile(r"[\p{L}\p{N}][\p{L}\p{N}'’\-]*")
_TAG = regex.compile(r"(?is)<!--.*?-->|</?(?:noscript|p|div|span|b|i|em|strong|br|hr|body|html|main|section|article|ul|li|title)\b[^>]*>")
_HEAD_TAG = regex.compile(r"(?is)<h(\d)\b[^>]*>.*?</h\1>|<(nav|footer|header)\b.*?</\2>")
_HAN = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}]")
_HIDDEN = regex.compile(r"[\u200b-\u200f\u2060\ufeff\u00ad\x00-\x08\x0b\x0c\x0e-\x1f\x7f]")


def _tidy(text: str) -> str:
    return _HIDDEN.sub("", text.replace("\r\n", "\n").replace("\r", "\n").replace("\u2028", "\n").replace("\x85", "\n").replace("\u00a0", " "))


def _blank(text: str, pattern: regex.Pattern) -> str:
    return pattern.sub(lambda m: _NOT_BREAK.sub(" ", m.group()), text)


def _quoted(sentence: str, start: int, end: int) -> bool:
    for opening, closing in _QUOTES:
        if opening == closing:
            if sentence[:start].count(opening) % 2 and closing in sentence[end:]:
                return True
        elif sentence.rfind(opening, 0, start) > sentence.rfind(closing, 0, start) and closing in sentence[end:]:
            return True
    return False


def open_slots(text: str) -> list[str]:
    """Slots of the text's own template that were left unfilled, those in code, formulas, quotes or talk about slots aside."""
    if not any(m in text for m in _MARKS) and not (("here" in text or "HERE" in text or "Here" in text) and _GOES_HERE.search(text)):
        return []
    text = _tidy(text)
    if not _SLOT.search(text):
        return []
    text = _blank(text, _FENCE)
    found = []
    for slot in _SLOT.finditer(text):
        line_start, line_end = text.rfind("\n", 0, slot.start()) + 1, text.find("\n", slot.end())
        line = text[line_start : line_end if line_end >= 0 else len(text)]
        a, b = slot.start() - line_start, slot.end() - line_start
        if any(m.start() <= a and b <= m.end() and not _SLOT.fullmatch(m.group()) for m in _MATHS.finditer(line)):
            continue
        sentence = next((m for m in _SENTENCE.finditer(line) if m.start() <= a < max(m.end(), m.start() + 1)), None)
        around = line[: max(a, 0)][-160:] + " " + line[b : b + 160] if sentence is None else line[min(sentence.start(), a) : a] + " " + line[b : max(sentence.end(), b)]
        if _quoted(line, a, b) or _TALK.search(_SLOT.sub(" ", around)) or regex.match(r"-(?:style|like|type)\b", line[b:]):
            continue
        found.append(slot.group())
    return found


def _units(text: str) -> Iterator[str]:
    """Units (lines, cut into sentences) of the text one after another, without frame and a first line that is a heading."""
    lines = [line.strip() for line in _TAG.sub("\n", _HEAD_TAG.sub("\n", _tidy(text))).split("\n") if line.strip()]
    for i, line in enumerate(lines):
        if _frame(line):
            continue
        if i == 0 and len(lines) > 1 and len(_WORD.findall(line)) <= 14 and not _STOP.search(line) and not _message(line):
            continue
        for part in _SPLIT.split(line):
            if part and (unit := part.strip()) and not _frame(unit):
                yield unit


def _frame(unit: str) -> bool:
    return len(unit) <= LONGEST_FRAME and bool(_FRAME.match(unit)) and not _message(unit)


def _kind(unit: str, words: list[str]) -> str | None:
    """The kind of message in a unit of these (lower-case) words."""
    signs = bool(_CODE.search(unit))
    for kind, cues, pattern in _MESSAGES:
        if (signs or not cues.isdisjoint(words)) and pattern.search(unit):
            return kind
    return None


def _message(unit: str) -> bool:
    return _kind(unit, [w.lower() for w in _WORD.findall(unit)]) is not None


def _plain_filler(units: list[str], words: list[str]) -> bool:
    if len(words) >= 4 and sum(w in LATIN for w in words) >= LATIN_SHARE * len(words):
        return True
    if len(words) >= 6 and len(set(words)) > max(12, DIFFERENT_SHARE * len(words)):
        return False
    if all(_KEYBOARD.match(w) for w in words):
        return True
    return len(words) >= 6 and len(set(words)) <= DIFFERENT_SHARE * len(words) and len({u.lower() for u in units}) <= max(1, len(units) // 2) and not _HAN.search(units[0])


def without_content(text: str) -> str | None:
    """``filler``, ``error`` or ``script`` if the body consists of that, else None. Quoted messages are content.

    Units are read until those of content outweigh what the whole text could spare.
    """
    whole = [w.lower() for w in _WORD.findall(text)]
    limit = (1 - DENSITY) * (len(whole) + (len(_HAN.findall(text)) if not text.isascii() else 0))
    # Frame aside, a text can only be mere filler if half of it looks so with its frame.
    if 2 * sum(w in LATIN for w in whole) >= LATIN_SHARE * len(whole) or len(set(whole)) <= max(24, 2 * DIFFERENT_SHARE * len(whole)):
        limit = float("inf")
    units, words, kinds, content, total = [], [], {"script": 0, "error": 0, "filler": 0}, 0, 0
    for unit in _units(text):
        part = [w.lower() for w in _WORD.findall(unit)]
        weight = len(part) + (len(_HAN.findall(unit)) // 2 if not unit.isascii() else 0)
        kind = _kind(_QUOTED.sub(" ", unit), part)
        if kind:
            kinds[kind] += weight
        elif not (units and weight <= 9 and any(kinds.values())):  # a short sentence may go on from a message
            content += weight
            if content > limit:
                return None
        units.append(unit)
        words += part
        total += weight
    if not words:
        return None
    if _plain_filler(units, words):
        return "filler"
    return max(kinds, key=kinds.get) if any(kinds.values()) and content <= (1 - DENSITY) * total else None


def residue_kind(text: str | None) -> str | None:
    """``slot``, ``filler``, ``error`` or ``script`` where the text isn't content, else None; None for null and blank."""
    if text is None or not text.strip():
        return None
    return "slot" if open_slots(text) else without_content(text)


def mark_residue(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key``, ``residue``: what each text is instead of content (``slot``, ``filler``, ``error``, ``script``), null for content.

    Works on whole texts where they lie, without a shuffle. Null, empty and blank texts are no cases; repeated rows are
    judged alike; an empty table gives no rows. Extra columns are ignored, whatever their names.
    """

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"key": batch["key"], "residue": [residue_kind(t) for t in batch["text"]]})

    out = T.StructType([T.StructField("key", df.schema[key].dataType), T.StructField("residue", T.StringType())])
    return df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInPandas(judge, out).withColumnRenamed("key", key)


def exclude_residue(df: DataFrame, text: str) -> DataFrame:
    """The rows of ``df`` whose text is content (or null, empty or blank), with all their columns."""
    judge = F.pandas_udf(lambda s: s.map(residue_kind), T.StringType())
    return df.where(judge(F.col(text)).isNull())
