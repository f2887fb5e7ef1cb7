"""Template residue, filler, error pages and script notices in place of content.

Texts are cut into paragraphs, lines and sentences. Numbers, dates, addresses and mark-up are masked, the rest is hashed and
equal messages are put together over all documents and sources. Placeholder and phrase rules look at the distinct messages;
one that quotes, explains or reports such text is none. Of what they find the names of things are masked as well, and the
frames that are left are hashed, grouped and counted over all documents and sources: a phrase in running text, a name in
square brackets and weak phrases count only where their frame recurs widely. At last an error or notice must stand in place of
content: it makes up most of its paragraph, or begins or ends it. Placeholders and filler count wherever they were left.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from re import _parser

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandframe.session import broadcast_if_small, cut

#: Documents in which a frame must stand before a phrase in running text or a weak one counts.
RECURS = 3
#: Share of its paragraph that an error or notice must make up, unless it begins or ends the paragraph.
SHARE = 0.5

#: Mark-up that is dropped; other angle brackets may be placeholders.
TAGS = r"(?i)</?(?:a|b|body|br|center|code|div|em|font|footer|h[1-6]|head|header|hr|html|i|img|li|main|nav|ol|p|pre|section|small|span|strong|table|tbody|td|th|title|tr|u|ul)(?:\s[^<>]*)?/?>"
#: Dates and numbers, and addresses where a text has any.
MASK = r"\d(?:[\d,.:/-]*\d)?|(?<![A-Za-z])(?:January|February|March|April|May|June|July|August|September|October|November|December)(?![A-Za-z])"
ADDRESS = r"(?i)\b(?:https?://|www\.)\S+|\b[\w.+-]{1,64}@[\w-]{1,64}(?:\.[\w-]{1,64})+"
#: White space other than the plain blank and the line feed.
ODD_SPACES = "\t\r\f\v\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: Ends of sentences within a line.
STOPS = r"([.!?][\"')]?) +"
WIDE_STOPS = r"([。！？])"

_NAME = r"[^\W\d_][\w.\- ]{0,40}"
#: What templates call the things to be filled in, and words that ask for it.
_FIELD = r"(?:name|title|date|day|time|number|count|size|length|id|e-?mail|address|phone|city|country|company|author|editor|subject|text|description|value|link|url|logo|image|photo|heading|content|product|price|project|customer|client|user|username|position|signature|reference)"
_ASKS = r"(?:your|insert|enter|add|fill|choose|type|replace|here|hier|ihre?|votre|vos|ici|su|sus|aquí|tu)"
_PLACEHOLDERS = [
    r"\{\{\s*[^\W\d_][^{}]{0,80}\}\}",
    r"<%[=-]?\s*[@$]?[^\W\d_][^<>%]{0,60}%>",
    r"\{%\s*[^\W\d_][^{}%]{0,60}%\}",
    rf"[#$]\{{\s*{_NAME}\s*\}}",
    rf"(?<![A-Za-z0-9_$#%{{])\{{{_NAME}\}}(?!\}})",
    r"(?<!\S)\{0\}(?=\s|[.,!?]|$)",
    rf"%\({_NAME}\)[sdf]",
    r"(?<!\S)%[sd](?=\s|[.,!?]|$)",
    rf"<<\s*{_NAME}\s*>>|<{_NAME}>|<(?:your|insert|enter)[^<>]{{1,40}}>",
    rf"«\s*{_NAME}\s*»",
    rf"\[\[\s*{_NAME}\s*\]\]",
    rf"(?<![A-Za-z0-9_\]\[])\[(?:\w+[_.]\w[\w.]*|(?:[\w.\-]+ )*{_FIELD}|(?:[\w.\-]+ )*{_ASKS}(?: [\w.\- ]{{1,40}})?)\](?![A-Za-z0-9_(\[])",
    r"\$[A-Za-z][A-Za-z0-9_.]{0,40}\$",
    r"(?<![A-Za-z0-9_%])%[A-Za-z][A-Za-z0-9_.]{1,40}%(?![A-Za-z0-9_])",
    r"@@?[A-Za-z][A-Za-z0-9_.]{1,40}@@?(?![A-Za-z0-9_.])|__[A-Za-z][A-Za-z0-9_.]+__",
    r"(?<![a-z0-9])(?:[a-z]+_)+here(?![a-z0-9_])|(?<![a-z0-9_$@%{<.])your_[a-z_]{2,40}",
]
_PLACEHOLDER = re.compile("|".join(_PLACEHOLDERS), re.I)
#: Square brackets around any other name: a citation or remark as often as a placeholder, so the frame must recur.
_BRACKET = re.compile(rf"(?<![A-Za-z0-9_\]\[])\[(?!(?:info|warn|warning|error|debug|fatal|trace|ok|fail|failed|sic|note)\b){_NAME}\](?![A-Za-z0-9_(\[])", re.I)

#: Text between quotation marks or backticks is reported, not said.
_QUOTED = re.compile(r"`[^`]*`|(?<!\w)\"[^\"]*\"|“[^”]*”|”[^”]*”|(?<!\w)’[^’]{2,}’(?!\w)|„[^“”]*[“”]|(?<!\w)'[^']{2,}'(?!\w)|(?<!\w)‘[^’]*’")
_EXPLAINS = re.compile(
    r"(?i)\bfield called\b|\bsection names?\b|\bplaceholder (?:for|is|of)\b|\bkeys such as\b|\bregular expression\b|\bprintf\s*\(|\bawk\b|\btemplate\b.*\b(?:fills?|filled|braces|replaces?)\b|\bin angle brackets\b|\bjob script\b|\bpair of braces\b"
    r"|\b(?:is|are) (?:replaced|expanded|substituted)\b|\bin place of\b|\bvariables? [$%{]|\buse [{<%$\[]|\bstands for\b"
)


def _split(pattern: str) -> list[str]:
    """The alternatives of a pattern."""
    out, depth, start, i = [], 0, 0, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            i += 1
        elif c == "[":
            i = pattern.index("]", i + 2)
        elif c in "()":
            depth += 1 if c == "(" else -1
        elif c == "|" and not depth:
            out.append(pattern[start:i])
            start = i + 1
        i += 1
    return [*out, pattern[start:]]


def _any(*phrases: str) -> list[re.Pattern]:
    """Every alternative of the phrases on its own."""
    return [re.compile(x, re.I) for p in phrases for x in _split(p)]


_SCRIPT = r"(?:java\s?script|js|(?:client-side |active )?script(?:s|ing)?)"
_THING = r"[\w ]{1,40}"
#: Status codes, as they are and masked.
_CODE = r"(?:0|400|401|403|404|410|429|500|502|503|504)"

#: Things that a site serves.
_PAGE = r"(?:web ?)?(?:page|site|content|resource|url|document|file|article|post|video|link|item|product|topic|thread|location|address|service|server|system|app|application)"
_SEEK = r"(?: (?:that )?(?:you(?:'re| are| were|'ve| have)? (?:looking for|searching for|requested|followed|trying to \w+|tried to \w+)|requested|/[\w./-]*))?"
_END = r"\W*(?:$|or\b|at\b|in your\b|on this\b|for you\b|from your\b|right now|please|properly|anymore|try\b)"

#: Values that a template left empty or that failed to print.
_EMPTY = _any(
    r"\bx{4,}\b|\bxx\.x+\b",
    r"(?:^|\s)\?{2,}(?=\s|$|[.,)])",
    r":\s*_{4,}",
    r"\w:\s*,\s*\w+:\s*\)",
    r":\s*undefined\b|\bundefined bp\b|\$undefined\b|\bnan of undefined\b|\bby (?:null|undefined)\W*$",
    r"\bfrom null\b|\bnull \w+ of null\b|\bof null on none\b",
    r"#(?:value|ref|name|n/a|div/0)[!?]?(?!\w)",
    r"\[object object\]",
    r":\s*%[sd]\b",
    r"\bvariable\s+'?\w*'?\s*is not set\b",
    r"\b(?:dear|hello|hi|liebe|hallo|bonjour|hola)\s+,",
    r"^\W*(?:todo|tbd|fixme)\b\W*(?::|-|$)|(?::|\bis|\bwas)\s+(?:tbd|todo|tba)\b|\btodo: ",
)
#: Filler in place of content.
_FILLER = _any(
    r"\b(?:asdf|qwer|zxcvb)\w*\b.*\b(?:asdf|qwer\w*|test|nnnn)\b",
    r"\bblah(?:[ ,]+blah)+",
    r"^\W*[\w ]{2,40} goes here\W*$|\b(?:text|content) goes here(?:\W*$|[.!])",
    r"\byour (?:text|heading|subheading|content|title|summary) here\b|^\W*(?:please )?(?:insert|enter|add|type|put|write|place) (?:your |the |some |a )?[\w ]{1,30} here\W*$",
    r"\bstart writing your content\b|\bedit this block\b|\bwelcome to your new (?:page|site|blog)\b|\bwelcome to wordpress\b|\bthis is your first (?:page|post)\b|\bjust another \w+ (?:site|weblog|blog)\b|\bedit or (?:remove|delete) this (?:text|post|page)\b|\bto change this text\b",
    r"\bthis is (?:just |only )?an? (?:sample|example|test|dummy) (?:paragraph|page|text|post)\b|\bthis is (?:just |only )?a placeholder\b|^\W*(?:sample|dummy|placeholder|example|filler|test) (?:text|content|paragraph|page|post|title|heading)\W*$",
    r"\breplace (?:it|this)(?: text| paragraph)? with\b|\badd a short description of\b|\bquick example text\b|\bdummy text\b|\bblindtext\b|\bfiller text\b|\bplaceholder text\b|^\W*hello,? world\W*$",
    r"\bto be (?:added|written|filled in|completed) by the (?:author|editor)|\(to be (?:written|added|done)\)|^\W*coming soon\W*$|\b(?:site|page) is under construction\b",
    r"\bin your own words, then\b|\benter [\w ]{1,40} in this field\b|\bclick here to (?:edit|add)\b",
    r"^\W*example [a-z ]{3,40} \d+\W*$",
    r"\bhier steht (?:später|ihr)\b|\bersetzen sie diesen\b|\bplatzhaltertext\b|\bvotre texte ici\b|\btexte d.exemple\b|\btexte de remplissage\b|\bsu texto aquí\b|\btexto de (?:ejemplo|relleno)\b",
    r"此处填写|请替换本段|示例文字|仅用于占位|占位(?:文字|文本)|在?此处?输入(?:文字|内容|标题)|点击此处添加",
    r"\bsed ut perspiciatis\b|\bat vero eos et accusamus\b",
)
#: Notices that scripts or a browser check are required.
_NOTICE = _any(
    rf"\b(?:enable|turn on|switch on|activate|allow) (?:your )?{_SCRIPT}\b",
    rf"\b{_SCRIPT}(?: and cookies)? (?:must|needs? to|has to|have to) be (?:switched on|turned on|enabled|activated)\b|\b{_SCRIPT} (?:(?:is|are)(?: currently)?|seems? to be|appears? to be) (?:disabled|required|turned off|switched off|blocked|not enabled|not supported|needed)\b",
    rf"\bbrowser (?:needs {_SCRIPT} for|has {_SCRIPT} (?:turned off|disabled))|\bdetect {_SCRIPT} in your browser\b|\bdo(?:es not|esn't) (?:work|function)(?: properly| correctly)? without {_SCRIPT}\b|\brequires {_SCRIPT}(?:\W*$| (?:to|in order)\b)|\bdo(?:es not|esn't) support {_SCRIPT}\b",
    r"\bactive content is blocked\b|\bbrowser is not supported\b|\bchecking (?:your browser|if the site connection)\b|\bverify(?:ing)? (?:that )?you are (?:a )?human\b|\bcomplete the (?:check|captcha|security check) (?:below|to)\b|^\W*just a moment\W*$|^\W*one moment,? please\W*$",
    r"\bddos protection by\b|^\W*attention required\b|\bare you a robot\b|\b(?:you are|you're|i'm|i am) not a robot\b|\bunusual traffic from your\b",
    rf"\baktivieren sie {_SCRIPT}\b|\bohne {_SCRIPT} kann\b|\bmuss {_SCRIPT} eingeschaltet sein\b|\b(?:benötigt|erfordert) {_SCRIPT}\b|\bmit aktiviertem {_SCRIPT}\b|\b{_SCRIPT} ist (?:deaktiviert|erforderlich)\b",
    rf"\bveuillez activer {_SCRIPT}\b|\b(?:exige|nécessite|requiert) {_SCRIPT}\b|\bsans {_SCRIPT}\W*$|\b{_SCRIPT} est désactivé\b",
    rf"^\W*active {_SCRIPT} para\b|\bnecesita {_SCRIPT}\W*$|\brequiere {_SCRIPT}\b|\bhabilite {_SCRIPT}\b|\b(?:activar|habilitar) {_SCRIPT} para\b|\btiene {_SCRIPT} desactivado\b|\b{_SCRIPT} está (?:desactivado|deshabilitado)\b",
    rf"启用\s*{_SCRIPT}|需要\s*{_SCRIPT}\s*支持|禁用了\s*{_SCRIPT}|不支持\s*{_SCRIPT}",
)
#: Messages of failed requests.
_ERROR = _any(
    rf"\byou (?:were|are) looking for (?:does not|could not|has been|was not)\b|\brequested {_THING} (?:was not found|does not exist|could not be found)|\bthat {_THING} can(?:'t|not) be found\b",
    rf"\b(?:the|this|that|your) (?:\w+ )?{_PAGE}{_SEEK} (?:is|was)(?:n't| not|n’t) (?:available|found|working|redirecting|accessible|responding){_END}",
    rf"\b(?:the|this|that|your) (?:\w+ )?{_PAGE}{_SEEK} (?:is (?:currently |temporarily )?unavailable|no longer exists|do(?:es not|esn't|esn’t) exist){_END}",
    rf"\b(?:the|this|that|your) (?:\w+ )?{_PAGE}{_SEEK} (?:can't|can’t|cannot|can not|could not|couldn't) be (?:found|reached|displayed|loaded|opened){_END}",
    rf"\b(?:the|this|that|your) (?:\w+ )?{_PAGE}{_SEEK} (?:(?:has|may have) been (?:re)?moved|has been deleted|may be broken){_END}",
    rf"\bwe (?:can't|can’t|cannot|couldn't|could not) find (?:the|that|this) {_PAGE}\b|\bnothing was found at this location\b|^\W*no results (?:were )?found\W*$|^\W*page not available\W*$",
    rf"\bcould not find an? {_THING} at this address\b|\bno {_THING} matches the given\b|\bhas been removed or is private\b|\blink you followed\b|^\W*check the address and try again\b",
    rf"^\W*{_CODE}\W+(?:bad request|unauthorized|forbidden|not found|gone|too many requests|internal server error|bad gateway|service (?:temporarily )?unavailable|gateway time-?out)\b",
    r"^\W*(?:error|http|fehler|erreur)\W* (?:400|401|403|404|410|429|500|502|503|504)\b|^\W*http status \d+\b",
    r"\bsession (?:has )?(?:expired|timed out)\b|^\W*log in again\b|\b(?:sign|log) in to continue\b|\b(?:be (?:signed|logged) in|need to (?:sign|log) in|have to (?:sign|log) in) to (?:view|see|access|continue|read|open|use|post)\b",
    r"\bdo(?:n't|n’t| not) have (?:the )?permission to\b|\bhas no rights for\b|\bavailable to members only\b|\bask the owner for access\b|\byou(?:'ve| have) been blocked\b|^\W*(?:this |your )?account (?:has been )?suspended\b",
    r"\brefused by the security rules\b|\brate limited\b|^\W*rate limit exceeded\b|\bexceeded (?:your|the) (?:request|rate|download|api) limit\b|\btoo many (?:requests|downloads) came\b|\bquota for this [\w ]{1,40} is used up\b|\bsite is over its\b",
    r"^\W*(?:please )?try again (?:later|tomorrow|in a)\b|\bcome back in a few minutes\b|^\W*wait \d+ seconds\b|^\W*contact the help desk\b|^\W*go back to the start page\b|^\W*return to the list of\b",
    r"\bmet an unexpected condition\b|\bcould not complete your request\b|\bteam has been notified\b|\bupstream server\b|\b(?:down|unavailable) for (?:scheduled )?maintenance\b|\bunable to show this\b|\bexception occurred while\b|\bdatabase connection could not\b|\btell the administrator\b|^\W*we(?:'ll| will) be (?:right )?back(?: soon| shortly)?\W*$",
    r"\bserver encountered an internal error\b|\bunable to (?:service|complete|process|handle) your request\b|\berror establishing a\b|\bhas been a critical error\b|\b(?:unexpected|unknown|server|internal) error (?:has )?occurred\b|^\W*(?:an )?error (?:has )?occurred(?: while (?:processing|loading|rendering) [\w ]{1,40})?\W*$|\bclient-side exception has occurred\b",
    r"^\W*(?:\w+\W+){0,3}(?:looks like )?something went wrong(?: while [\w ]{1,40})?(?:\W*$|\W+(?:please|try)\b)|^\W*your connection was (?:interrupted|reset)\b",
    r"^\W*traceback \(most recent call last\)|^\W*keyerror:|\bwarning: \w+\(\): argument|^\W*file \S+, line \d+,? in\b|^\W*(?:fatal|parse) error: (?:uncaught|syntax|call to|allowed memory)|^\W*(?:warning|notice|deprecated): undefined \w+|^\W*java\.lang\.\w+|^\W*exception in thread\b",
    r"\bnicht bearbeitet werden\b|\bderzeit nicht erreichbar\b|\bversuchen sie es später\b|\bprüfen sie die adresse\b|\bangeforderte seite\b|\bunter dieser adresse nicht\b|\bmelden sie sich erneut an\b|\bseite wurde nicht gefunden\b|\bseite existiert (?:leider )?nicht\b|\binterner serverfehler\b|\bunerwarteter fehler ist aufgetreten\b|^\W*zugriff verweigert\b|\bkeine berechtigung\b|\bsitzung ist abgelaufen\b|^\W*nicht gefunden\W*$",
    r"\bn.avez pas les droits\b|\baucune page ne correspond\b|\bréessayer plus tard\b|\bn.a pas pu être traitée\b|\bveuillez vous reconnecter\b|\bdocument demandé n.existe\b|\bpage que vous (?:recherchez|demandez|cherchez)\b|\bpage introuvable\b|^\W*accès refusé\b|\berreur interne\b|^\W*une erreur (?:inattendue )?est survenue\W*$|\bsession a expiré\b|\bservice indisponible\b|\btemporairement indisponible\b|\bvérifiez l.adresse\b",
    r"\bsesión ha caducado\b|\benlace puede estar roto\b|\brevise la dirección\b|\bno se pudo completar la solicitud\b|\bsolicitado no existe\b|\bpágina que (?:busca|buscas|solicita|solicitó)\b|\binicie sesión de nuevo\b|\bservicio no (?:está )?disponible\b|\bpágina no encontrada\b|\bha ocurrido un error\b|\berror interno del servidor\b|^\W*acceso denegado\b|\binténtelo más tarde\b|\bno tiene permiso\b",
    r"请求无法完成|您没有查看|没有找到该|您访问的页面|请返回首页|访问被拒绝|请稍后再试|服务暂不可用|请先登录|服务器内部错误|请检查网址|页面不存在|页面未找到|系统维护中|^\W*出错了|^\W*服务器错误",
)
_HEADS = "http |error |fehler |erreur "
_HEADED = (
    r"access denied|permission problem|login required|request (?:blocked|failed)|limit reached|session expired|application error|unexpected error|(?:internal )?server error|something went wrong"
    r"|page (?:missing|not found)|not found|service unavailable|bad gateway|gateway time-?out|forbidden|gone|unauthorized|too many requests|slow down|service temporarily unavailable|account suspended|page not available|oops|whoops|hoppla|oups|ups|désolé|lo sentimos|entschuldigung|哎呀|抱歉|sorry|restricted|nothing here|we looked everywhere"
    r"|nicht gefunden|seite nicht gefunden|zugriff verweigert|interner serverfehler|page introuvable|page non trouvée|accès refusé|accès interdit|erreur interne du serveur|service indisponible|página no encontrada|acceso denegado|error interno del servidor|servicio no disponible"
    r"|页面不存在|页面未找到|访问被拒绝|服务器内部错误|服务暂不可用|出错了"
)
#: The words of the headings below.
_HEADINGS = f"{_HEADS}|{_HEADED}"
#: Headings of error pages; a message made of nothing else is one.
_TITLES = re.compile(rf"(?:[\W_]*(?:(?:{_HEADS})?\d+(?!\d)|(?:{_HEADED})(?![^\W\d_])))+[\W_]*", re.I)
#: Phrases too weak to count unless they recur.
_WEAK = _any(r"^\W*loading [\w ]{1,40}\.\.\.", r"\bthis may take a few seconds\b", r"^\W*(?:error|http|fehler|erreur) \d+\W*$")

#: The commonest filler text, in any rotation.
_LATIN = set("lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua quis nostrud ullamco laboris nisi vel illum fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt in culpa qui officia deserunt mollit anim id est laborum enim ad minim veniam exercitation aliquip ex ea commodo consequat duis aute irure reprehenderit voluptate velit esse cillum eu".split())
_WORD = re.compile(r"[^\W\d_]+")
_ENTITY = {"&lt;": "<", "&gt;": ">", "&amp;": "&", "&quot;": '"', "&#39;": "'", "&nbsp;": " "}


#: Words of which running text in the languages of the corpus holds at least one.
_COMMON = set(
    "the a an of to and in is are was were be been on for with from by at as it its that this these those which or not no but so we our us i you your they their them he she his her has have had will would can could should may after before than then into over under between if when where how what why all only each every both more most less same other one two there here please do does did "
    "der die das den dem des ein eine einer einen und oder ist sind war wurde wurden nicht mit von zu zum zur im in auf für an bei nach wir sie es sich bis aus als wie zwischen denselben auch noch aber "
    "le la les un une du des de et ou est sont était en au aux pour par sur pas nous vous ne se que qui dans avec ce cette il elle "
    "el los las y o es son para con no al del lo su sus se una unos este esta por como más pero".split()
)
#: Words without any common one from which a sentence counts as made up.
MADE_UP = 9
#: Words with single blanks between them, in lower case but for their first letters.
_PLAIN = re.compile(r"[A-Za-z][a-z]*(?: [A-Za-z][a-z]*)*[.!?]?")
#: Words from which a sentence counts as made up if all of them are long and put together from open syllables.
FEW = 4
#: A word of open syllables, as generators put them together.
_FLUENT = re.compile(r"(?:[bcdflmnpqrstv]{0,2}[aeiou]{1,3})+[lmnrst]?", re.I)


def _latin(text: str) -> bool:
    low = _WORD.findall(text.lower())
    if len(low) < FEW:
        return False
    latin = [w in _LATIN for w in low]
    if sum(latin) >= 5:
        run = 0
        for x in latin:
            run = run + 1 if x else 0
            if run >= 5:
                return True
    if not _COMMON.isdisjoint(low) or _PLAIN.fullmatch(text) is None:
        return False
    return len(low) >= MADE_UP or all(len(w) > 3 and _FLUENT.fullmatch(w) for w in low)


def _cost(literal: str) -> float:
    """About how often running text holds a literal."""
    return 30.0 ** -len(literal) * (20 if literal in _COMMON or literal in ".,:" else 1)


def _literals(parsed: Iterable) -> set[str]:
    """Strings without white space, one of which stands in lower case in every text that the parsed pattern matches; none if
    there are no such strings. The rarest are taken."""
    options: list[set[str]] = []
    run: list = []

    def end() -> None:
        options.extend({part} for part in "".join(chr(x).lower() for _, x in run).split())
        run.clear()

    for op, arg in parsed:
        name = str(op)
        if name == "LITERAL":
            run.append((op, arg))
        elif name in ("MAX_REPEAT", "MIN_REPEAT") and len(arg[2]) == 1 and str(arg[2][0][0]) == "LITERAL":
            run.extend([arg[2][0]] * min(arg[0], 9))
            if arg[0] != arg[1]:
                end()
        elif name in ("MAX_REPEAT", "MIN_REPEAT"):
            end()
            if arg[0]:
                options.append(_literals(arg[2]))
        elif name in ("SUBPATTERN", "BRANCH", "IN"):
            # what stands before the alternatives belongs to each of them
            if name == "IN":
                parts = [[x] for x in arg] if all(str(x[0]) == "LITERAL" for x in arg) else [[]]
            else:
                parts = [arg[-1]] if name == "SUBPATTERN" else arg[1]
            each = [_literals([*run, *x]) for x in parts]
            options.append(set().union(*each) if all(each) else set())
            end()
        elif name != "AT":
            end()
    end()
    return min(filter(None, options), key=lambda o: sum(map(_cost, o)), default=set())


#: Literals that are parts of common words; their rules take them as whole words, or after another heading that is listed.
_WHOLE = {"hi", "ups"}


def _needed(pattern: str) -> set[str]:
    """Literals of which a match holds one; there must be some, or the gate would miss it."""
    got = _literals(_parser.parse(pattern, re.I))
    if not got:
        raise ValueError(f"an alternative without a literal: {pattern!r}")
    return got - _WHOLE


#: The phrase rules by kind, and the headings, which are one rule.
_TABLES = {"placeholder": _EMPTY, "filler": _FILLER, "notice": _NOTICE, "error": _ERROR, "weak": _WEAK, "title": [_TITLES]}


def _automaton() -> ahocorasick.Automaton:
    """Finds the literals of all rules in one pass; each tells the rules that need it."""
    uses: dict[str, set[re.Pattern]] = {}
    for name, table in _TABLES.items():
        for r in table:
            for x in _split(_HEADINGS) if name == "title" else [r.pattern]:
                for literal in _needed(x):
                    uses.setdefault(literal, set()).add(r)
    a = ahocorasick.Automaton()
    for literal, rules in sorted(uses.items()):
        a.add_word(literal, frozenset(rules))
    a.make_automaton()
    return a


#: Letters that ignoring case takes for others (long s, Kelvin, i).
_ODD = re.compile("[\u017f\u212a\u0130\u0131]")
#: What every placeholder has.
_MARKS = re.compile(r"[{«$@<]|\[(?!(?:INFO|WARN|ERROR|DEBUG)\])(?:\[|[^\W\d_])|%[A-Za-z(]|__|(?i:your_|_here)")
_NEEDED = _automaton()
_WORDS = re.compile(rf"(?<![^\W\d_])(?:{'|'.join(sorted(_WHOLE))})(?![^\W\d_])")
_QUOTES = re.compile("[`\"“”’„‘']")


def _plain(message: str) -> str:
    if "&" in message:
        for a, b in _ENTITY.items():
            message = message.replace(a, b)
    return message


#: Who tells of a message or what it led to: the message is reported and does not stand in place of content.
_TELLS = re.compile(
    r"(?i)\b(?:failed|ended|stopped|crashed|died|answered|replied|responded|returned|returns|logged|called|complain\w*) (?:with|in|by|that|about|us|me|him|them) (?:\w+ )?$"
    r"|\b(?:says?|said|saying|showed|shows?|reported|reports|means?|gave|gives|got|saw|seen|see|explains?) (?:(?:with|in|by|that|about|of|us|me|a|an|the|him|them|why) )*$|\b(?:messages?|notices?|warnings?|errors?) (?:that|about|of|by|why|says|said|saying) (?:\w+ )?$"
)
_WHO = re.compile(
    r"(?i)\b(?:i|my|he|she|they|users|people)\b(?! am not)|\bwe\b(?! (?:are|were|can|can't|cannot|could|couldn't|have|looked|need|apolog\w+|noticed|detected)\b)|\bour (?!\w+ (?:is|are|has|have)\b)"
    r"|\bwir\b(?! (?:können|konnten|bitten|haben))|\bnous\b(?! (?:sommes|ne|n|avons été))|\b(?:activamos|hemos|usamos)\b|我们(?!无法|检测|很抱歉|暂时)"
)
_WENT_ON = re.compile(r"(?i)^ (?:was|were|is a|that|which)\b|\b(?:so|and|but|until|because|since|after|before) (?:we|i|he|she|it|they|the (?:job|run|transfer|calculation) (?:is|was|had|has|went|ended|stopped|finished)|at|today)\b|\bbecause\b|\bif (?:the|your|a|memory)\b|\bwhen (?:the|a|we)\b|\bso (?:that )?the \w+ can be\b|\bcomes from\b|\bverwendet\b|\bdamit\b|\bweil\b")
_SENTENCE = re.compile(r"[.!?。！？]\s*")
#: Words beyond which a message is running text that holds a phrase; it counts only where its frame recurs.
SHORT = 30


def _reported(text: str, hit: re.Match) -> bool:
    before, after = _SENTENCE.split(text[: hit.start()])[-1], _SENTENCE.split(text[hit.end() :])[0]
    who = _WHO.search(before + hit[0])
    return bool(_TELLS.search(before) or who and who.start() < len(before) or _WENT_ON.search(after))


def rule(message: str, only: set[re.Pattern] | None = None, marks: bool = True) -> tuple[str, bool] | None:
    """(kind, whether its frame must recur) by all rules in order, or by ``only`` some of them and without placeholders if
    there are no ``marks``; None for real content."""
    text = _plain(message)
    said = _QUOTED.sub(" ", text) if _QUOTES.search(text) else text

    def hits(name: str) -> Iterator[re.Match]:
        return (h for r in _TABLES[name] if only is None or r in only for h in r.finditer(said))

    if marks and _PLACEHOLDER.search(said) or next(hits("placeholder"), None):
        if not _EXPLAINS.search(text):
            return "placeholder", False
    elif marks and _BRACKET.search(said) and not _EXPLAINS.search(text):
        return "placeholder", True
    if _latin(said):
        return "filler", False
    for kind in ("filler", "notice", "error"):
        if any(not _reported(said, h) for h in hits(kind)):
            return kind, len(_WORD.findall(said)) > SHORT
    if (only is None or _TITLES in only) and _TITLES.fullmatch(said) and _WORD.search(said):
        return "error", False
    return ("error", True) if next(hits("weak"), None) else None


def gated(message: str) -> tuple[str, bool] | None:
    """``rule``, asked only for the rules of which the message holds a literal."""
    text = _plain(message)
    low = text.lower()
    if _ODD.search(text) or _WORDS.search(low):
        return rule(message)
    only = set().union(*(rules for _, rules in _NEEDED.iter(low)))
    marks = _MARKS.search(text) is not None
    if only or marks:
        return rule(message, only, marks)
    # only filler in made-up or stock words is left
    return ("filler", False) if _latin(_QUOTED.sub(" ", text) if _QUOTES.search(text) else text) else None


def classify(message: str, docs: int = 1) -> str | None:
    """placeholder, filler, notice or error; None for real content. ``docs``: documents that hold the message's frame."""
    got = gated(message)
    return got[0] if got and (docs >= RECURS or not got[1]) else None


#: Words that the rules or running text know; all others are slots of a frame.
_KNOWN = _COMMON | set(re.findall(r"[a-zà-ÿ]{3,}", " ".join(x.pattern for t in (_EMPTY, _FILLER, _NOTICE, _ERROR, _WEAK) for x in t)))
_SLOT = re.compile(r"(?:¤\W*)+")


def frame(message: str) -> str:
    """The message with placeholders, numbers and the names of things masked: what recurs when a template is filled anew."""
    text = _BRACKET.sub("¤", _PLACEHOLDER.sub("¤", _plain(message))).lower()
    return _SLOT.sub("¤ ", _WORD.sub(lambda w: w[0] if w[0] in _KNOWN else "¤", text.replace("0", "¤"))).strip()


_FOUND = "hash long, message string, kind string, recurs boolean, frame string"


def _classified(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for p in parts:
        got = [(h, m, *r, frame(m)) for h, m in zip(p["hash"], p["message"], strict=True) if (r := gated(m))]
        yield pd.DataFrame(got, columns=["hash", "message", "kind", "recurs", "frame"])


def _masked(text: str) -> Column:
    t = F.regexp_replace(F.col(text), TAGS, "\n")
    t = F.when(F.contains(t, F.lit("@")) | F.contains(t, F.lit("://")) | F.contains(t, F.lit("www.")), F.regexp_replace(t, ADDRESS, "0")).otherwise(t)
    return F.regexp_replace(F.regexp_replace(F.translate(t, ODD_SPACES, " " * len(ODD_SPACES)), MASK, "0"), " {2,}", " ")


def _lines(t: Column) -> Column:
    """Lines and sentences of a masked text, equal ones once."""
    return F.array_distinct(F.split(F.regexp_replace(F.regexp_replace(t, STOPS, "$1\n"), WIDE_STOPS, "$1\n"), "\n"))


def _bare(message: Column) -> Column:
    return F.rtrim(F.ltrim(message, F.lit(" >*•-")))


def messages(docs: DataFrame, doc: str, text: str, source: str) -> DataFrame:
    """(doc, source, hash, message): the distinct masked lines and sentences of every document."""
    rows = docs.select(F.col(doc).alias("doc"), F.col(source).alias("source"), F.explode(_lines(_masked(text))).alias("message"))
    rows = rows.withColumn("message", _bare(F.col("message"))).where("message != ''")
    return rows.withColumn("hash", F.xxhash64(F.lower("message")))


def standing(docs: DataFrame, doc: str, text: str, pages: DataFrame) -> DataFrame:
    """(doc, kind): pages (doc, hash, kind), the errors and notices of documents, where they stand in place of content: they
    make up SHARE of their paragraph's letters, or one of them begins or ends it. Other documents are not cut again."""
    ids = broadcast_if_small(cut(pages.select("doc").distinct()))
    held = docs.select(F.col(doc).alias("_doc"), F.col(text).alias("_text")).join(ids, F.col("_doc").eqNullSafe(F.col("doc")), "left_semi")
    blocks = held.select(F.col("_doc").alias("doc"), F.posexplode(F.split(_masked("_text"), "\n *\n")).alias("block", "_b"))
    lines = F.filter(F.transform(_lines(F.col("_b")), _bare), lambda m: m != "")
    rows = blocks.select("doc", "block", lines.alias("_l")).select("doc", "block", F.aggregate("_l", F.lit(0), lambda n, m: n + F.length(m)).alias("size"), F.size("_l").alias("_n"), F.posexplode("_l").alias("_i", "message"))
    rows = rows.select("doc", "block", "size", ((F.col("_i") == 0) | (F.col("_i") == F.col("_n") - 1)).alias("edge"), F.length("message").alias("letters"), F.xxhash64(F.lower("message")).alias("hash"))
    kept = rows.join(broadcast_if_small(pages.select("hash", "kind").distinct()), "hash").groupBy("doc", "block").agg(F.collect_set("kind").alias("kinds"), F.sum("letters").alias("held"), F.max("size").alias("size"), F.max("edge").alias("edge"))
    return kept.where((F.col("held") >= SHARE * F.col("size")) | F.col("edge")).select("doc", F.explode("kinds").alias("kind"))


def residue_messages(docs: DataFrame, doc: str, text: str, source: str) -> tuple[DataFrame, DataFrame]:
    """(hits, messages): where classified messages were found (doc, hash, kind), and every classified message with the
    number of documents and whether several sources hold its frame (hash, docs, sources, message, kind)."""
    rows = cut(messages(docs, doc, text, source))
    seen = rows.groupBy("hash").agg(F.min("message").alias("message"))
    kinds = cut(seen.mapInPandas(_classified, _FOUND))
    # what is left is a small part of the messages; a frame is counted over all documents and sources
    hits = cut(rows.drop("message").join(broadcast_if_small(kinds.select("hash", "frame")), "hash"))
    frames = hits.groupBy("frame", "doc").agg(F.min("source").alias("lo"), F.max("source").alias("hi"))
    count = cut(frames.groupBy("frame").agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.min("lo") != F.max("hi"), F.lit(False)).alias("sources")))
    wide = cut(kinds.join(broadcast_if_small(count), "frame").where(~F.col("recurs") | (F.col("docs") >= RECURS)).select("hash", "docs", "sources", "message", "kind"))
    return hits.select("doc", "hash").join(broadcast_if_small(wide.select("hash", "kind")), "hash"), wide


def residue(docs: DataFrame, doc: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(doc, kinds): documents with residue, filler, error pages or script notices. Null and empty texts are none, a null
    source is a source of its own; repeated rows of a document are one. An empty table gives an empty table."""
    hits, _ = residue_messages(docs, doc, text, source)
    hits = cut(hits)
    page = F.col("kind").isin("notice", "error")
    left = hits.where(~page).select("doc", "kind").unionByName(standing(docs, doc, text, hits.where(page)))
    return left.groupBy("doc").agg(F.sort_array(F.collect_set("kind")).alias("kinds")).withColumnRenamed("doc", doc)
