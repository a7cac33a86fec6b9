"""Template residue, filler, error pages and script notices in place of content (problem 8).

A record is read the way its reader would see it: comments, skipped blocks, code and verbatim text are taken out first, as an
article may well show or discuss a template there. What remains is cut into passages: title, author list, abstract,
headings and the paragraphs of the body. Each passage is then judged on its own. It is residue if its text is (nearly) nothing else:
slots by one grammar for each kind of delimiter, instructions to an author, filler, or an error message or notice. A
sentence that mentions such text among words of its own has another beginning and a low density, and stays, as does one
that explains the syntax of a slot.

The rules on instructions, messages and notices name the phrases that they begin with. All these phrases are one Aho-Corasick
automaton: a passage without any of them, as nearly all are, is never read by a rule.
"""

from __future__ import annotations

import re
from bisect import bisect_left as bisect
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import product
from operator import itemgetter
from string import ascii_lowercase
from typing import TypeVar

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

T = TypeVar("T")

# The vocabulary of the common Latin filler text.
LOREM = frozenset(
    """ad adipiscing adipisicing aliqua aliquip aliquam amet anim ante aute augue bibendum cillum commodo condimentum consectetur consectetuer
    consequat convallis culpa cupidatat cursus dapibus deserunt diam dignissim do dolor dolore donec duis ea efficitur egestas eget eiusmod
    eleifend elit elementum enim erat eros esse est et etiam eu euismod ex excepteur exercitation facilisis faucibus felis
    fermentum feugiat fringilla fugiat gravida hendrerit iaculis id imperdiet in incididunt integer interdum ipsum irure
    justo labore laboris lacinia lacus laborum laoreet lectus leo libero ligula lobortis lorem luctus maecenas magna malesuada mattis
    mauris maximus metus mi minim mollit mollis morbi nam nec neque nibh nisi nisl non nostrud nulla nullam nunc odio officia
    orci ornare pariatur pellentesque phasellus porta porttitor posuere praesent pretium proident pulvinar purus quam qui quis
    reprehenderit rhoncus risus rutrum sagittis sapien scelerisque sed sem semper sint sit sodales sollicitudin sunt
    suscipit suspendisse tellus tempor tempus tincidunt tortor tristique turpis ullamco ullamcorper ultrices ut
    varius vel velit vehicula veniam vestibulum vitae vivamus viverra volutpat voluptate vulputate""".split()
)

# Words of it that other languages don't share.
_LATIN_WORDS = (
    "lorem ipsum amet consectetur eiusmod incididunt commodo labore cupidatat proident nostrud mollit veniam aliqua excepteur "
    "vivamus rutrum officia deserunt pariatur fugiat laboris tempor adipiscing voluptate pellentesque vestibulum"
).split()
_LATIN = re.compile(rf"(?<!\S)(?:{'|'.join(_LATIN_WORDS)})\b", re.IGNORECASE)

# What is typed to fill a space, and the words that are typed with it but also have a meaning.
TYPED_WORDS = frozenset("text test word words sample dummy string bar and".split())
KEYS = frozenset("asdf asdfg asdfgh asdfjkl jkl sdf qwer qwert qwerty qwertz qwertyuiop etaoin shrdlu hjkl".split())
TYPED = TYPED_WORDS | KEYS | frozenset("blah bla foo foobar baz qux yada".split())
_ONE_LETTER = re.compile(r"x{3,}|([a-z])\1{4,}")

# Commands that typeset filler.
FILLER_COMMANDS = r"\\(?:lipsum|Blindtext|blindtext|Blinddocument|blinddocument|blindlist\w*|blindmathpaper|kant|zblindtext|lorem|pangram)(?![A-Za-z])\*?(?:\[[^\]\n]*\]|\{[^}\n]*\})*"
_FILLER_NAMES = ("\\lipsum", "\\blind", "\\kant", "\\zblindtext", "\\lorem", "\\pangram")
_FILLER_LINE = re.compile(rf"(?:{FILLER_COMMANDS}\s*)+\.?")

# What an author is told to write, by language.
PART = r"(?:abstract|title|text|section|paragraph|content|body|introduction|summary|keywords?|results?|conclusions?|discussion|methods?|caption|names?|affiliations?|authors?|data ?set|figure|table|paper|article|acknowledge?ments?)"
TEIL = r"(?:zusammenfassung|text|abschnitt|titel|inhalt|einleitung|name|autoren?|absatz|ergebnisse|kurzfassung)"
PARTIE = r"(?:résumé|texte|section|titre|contenu|introduction|nom|auteurs?|paragraphe|résultats|conclusion)"
PARTE = r"(?:resumen|texto|título|sección|contenido|introducción|nombre|autor(?:es)?|párrafo|resultados|conclusi(?:ón|ones))"


def _any(*alternatives: str) -> re.Pattern:
    return re.compile("|".join(f"(?:{x})" for x in alternatives), re.IGNORECASE)


class Rules:
    """Patterns, each with the plain phrases that its matches begin with.

    A pattern is tried only where one of its phrases stands, so a text without any of the phrases holds no match.
    """

    def __init__(self, *rules: tuple[str, str]):
        self.rules = [(tuple(heads.split("|")), _any(pattern)) for heads, pattern in rules]
        self.heads = sorted({head for heads, _ in self.rules for head in heads})
        self.anywhere = _any(*(pattern for _, pattern in rules))

    def match(self, text: str, full: bool = False) -> re.Match | None:
        """The match of the first rule that holds at the beginning of ``text``, of all of it if ``full``."""
        lower = text.lower()
        for heads, pattern in self.rules:
            if lower.startswith(heads) and (found := pattern.fullmatch(text) if full else pattern.match(text)):
                return found
        return None


def _each(*parts: str) -> str:
    """All phrases made of one alternative of each part."""
    return "|".join(map("".join, product(*(part.split("|") for part in parts))))


#: Slots, one grammar for each kind of delimiter. An identifier may have a path and filters, but it is no sentence.
SLOT = re.compile(
    r"""
      (?<![=\\\w{])\{\{\{?[#/^&>!]?\s*[A-Za-z_][\w.\-]*(?:\s*\|[^{}]*)?\s*\}?\}\}(?!\})   # {{ name }}, {{{name}}}, {{#list}}
    | (?<!=\ )(?<![=\\\w])\{%-?\s*[a-z]\w*[^%\n]*%\}                                            # {% block %}
    | \$\{[A-Za-z_][\w.\-]*(?::-?[^}\n]*)?\}                                                # ${name}
    | <%[=\-\#@]?[^%\n]*%>  | <\?(?:=|php\b)[^?\n]*\?>  | <[\#@](?:include|if|list|assign|import|macro)\b[^>\n]*>   # <% %>, <?= ?>, <#include>
    | \[\[\s*[A-Za-z_][\w.\- ]*\s*\]\]                                                       # [[name]]
    | @@?[A-Z][A-Z0-9_]{2,}@@?                                                               # @NAME@
    | %%?[A-Z][A-Z0-9_]{2,}%%?                                                               # %NAME%
    | \$\$?[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+\$\$? | \$\$[A-Z]{4,}\$\$ | \$[A-Z]{5,}\$            # $NAME$
    | (?<![A-Za-z0-9_])__[A-Z][A-Z0-9_]*__(?![A-Za-z0-9_])                                   # __NAME__
    | (?<![\\\w\]})^_$=])(?<!\\[,;:!])\{(?:\d|[a-z][a-z]*(?:[_.][a-z0-9]+)*)\}(?![\w{^_])        # {name}, {0}
    | \#\{[a-z_][\w.]*\}                                                                      # #{name}
    """,
    re.VERBOSE,
)

#: What any slot begins with; most passages have none of it.
_OPENING = re.compile(r"\{(?:[{%]|(?<![\\\w\]})^_$=]\{)[\da-z])|[$#]\{|<[%?#@]|\[\[|@[A-Z]|%[A-Z]|\$[A-Z]{2}|__[A-Z]")

#: Words of a sentence that explains a slot or the language that it belongs to, and signs around one that is quoted.
_SYNTAX = re.compile(
    r"\b(?:syntax|templat\w*|variables?|placeholders?|slots?|written|denote[sd]?|stands? for|means|expand(?:s|ed)?|expansion|substitut\w+|replaced|interpolat\w+|format(?:s|ted|ting)?|strings?|braces|brackets|"
    r"delimiters?|notation|expressions?|parsers?|grammars?|compilers?|shells?|scripts? language|jinja2?|mustache|handlebars|django|liquid|twig|python|perl|php|ruby|erb|bash|sed|velocity|freemarker|angular|vue)\b",
    re.IGNORECASE,
)
_QUOTES, _UNQUOTES = ("``", '"', "'", "`", "“", "‘", "«", "„"), ("''", '"', "'", "`", "”", "’", "»", "“")
_BRACKETS = "[<*("

#: An instruction in brackets, angle brackets or stars that is a line of its own.
_HINT = rf"\b(?:insert|add(?:ed)?|fill|to-?do|tbd|tba|fixme|your|here|describe|placeholder|to be|about here|goes here|write|type|enter|replace|lorem|blank|dummy|texte?|texto|insérer|inserer|compléter|completer|rédiger|ajouter|einfügen|einfuegen|ergänzen|eingeben|folgt|hier|insertar|inserte|añadir|agregar|completar|rellenar|escriba|aquí|{PART[3:-1]})\b"
BRACKETED = re.compile(rf"^(?:\[(?=[^\]\n]*{_HINT})[^\[\]\n|]{{3,160}}\]|<(?![/!?]|(?:html|head|body|meta|div|p|br|hr|span|script|noscript|center|h\d)\b)(?=[^>\n]*{_HINT})[^<>\n|=\"]{{3,160}}>|\*{{2,}}(?=[^*\n]*{_HINT})[^*\n]{{3,160}}\*{{2,}}|\({{2}}[^()\n]{{3,160}}\){{2}})[.:]?$", re.IGNORECASE)

_PARTS = "abstract|title|text|section|paragraph|content|body|introduction|summary|keyword|result|conclusion|discussion|method|caption|name|affiliation|author|data set|dataset|figure|table|paper|article|acknowledgment|acknowledgement"
_TEILE = "zusammenfassung|text|abschnitt|titel|inhalt|einleitung|name|autor|absatz|ergebnisse|kurzfassung"
_PARTIES = "résumé|texte|section|titre|contenu|introduction|nom|auteur|paragraphe|résultats|conclusion"
_PARTES = "resumen|texto|título|sección|contenido|introducción|nombre|autor|párrafo|resultados|conclusi"

#: Sentences that instruct an author or announce text to come. They make up most of a passage, whatever its length.
INSTRUCTION = Rules(
    (
        "please |insert|type|write|enter|put|add|paste|place|provide|replace|fill in|describe",
        rf"(?:please )?(?:insert|type|write|enter|put|add|paste|place|provide|replace|fill in|describe)(?: in)?(?: (?:your|the|this|an?|some))?(?: (?:own|short|brief|paper'?s?|article'?s?))* {PART}\b[^.]{{0,50}}",
    ),
    ("click|tap", r"(?:click|tap)(?: here)? to (?:add|enter|edit|insert)\b[^.]{0,40}"),
    (_each("your ", _PARTS), rf"your {PART} (?:comes|goes|here|should|will|belongs)\b[^.]{{0,50}}"),
    (_each(_PARTS, "|s", " here| text| comes| goes| belongs"), rf"{PART}(?: text)? (?:comes |goes |belongs )?here"),
    ("this is |here is ", r"(?:this|here) is (?:(?:a|an|the|only|just|some) )*(?:placeholder|(?:dummy|filler|sample|blind|boilerplate) (?:text|paragraph|section|abstract))\b[^.]{0,60}"),
    (_each("this |the ", _PARTS, "|s", " is| was| will| serves"), rf"(?:this|the) {PART} (?:is|serves as|was|will be) (?:just |only )?(?:a |an |left )?(?:placeholder|dummy|filler|sample|intentionally blank|written later|added later)\b[^.]{{0,60}}"),
    ("xxx|placeholder|dummy|filler", rf"(?:xxx+ )?(?:placeholder|dummy|filler)(?: {PART})*(?: xxx+)?"),
    (
        _each(_PARTS, "|s", ":|,| -| –| to | is | are | text| coming| forthcoming| missing| pending"),
        rf"{PART}(?: text)?(?:[:,]| [–-])* ?(?:is |are )?(?:to be (?:added|written|completed|inserted|provided|filled(?: in)?|determined|announced|done)|to come|coming soon|forthcoming here|missing here|pending)\b[^.]{{0,40}}",
    ),
    (
        "separate text|delete this|do not edit|do not delete|under construction|content coming|include keywords",
        r"separate text sections\b[^.]{0,50}|include keywords as\b[^.]{0,30}|delete this (?:text|paragraph|section)[^.]{0,50}|do not (?:edit|delete) this[^.]{0,40}|under construction|content coming soon",
    ),
    ("dies ist|dies steht|hier ist|hier steht", r"(?:dies|hier) (?:ist|steht)(?: nur)? (?:ein |der |ihr )?(?:blindtext|platzhalter(?:text)?|beispieltext|fülltext|text)\b[^.]{0,60}"),
    ("er dient nur", r"er dient nur dazu, den platz[^.]{0,60}"),
    (_each("|bitte ", "|hier ", "|ihr |ihre |ihren |die |den ", _TEILE), rf"(?:bitte )?(?:hier )?(?:ihre?n? |die |den )?{TEIL} (?:hier )?(?:einfügen|ergänzen|eingeben|eintragen|schreiben|folgt|fehlt noch)"),
    ("fügen sie|geben sie|tragen sie|schreiben sie", rf"(?:fügen|geben|tragen|schreiben) sie (?:hier )?(?:ihre?n? |die |den |das )?{TEIL}[^.]{{0,40}}"),
    (_each(_PARTIES, "|s", " à "), rf"{PARTIE} à (?:compléter|insérer|rédiger|ajouter|venir|écrire|remplir)[^.]{{0,40}}"),
    ("insérez|ajoutez|saisissez|écrivez|tapez|rédigez", rf"(?:insérez|ajoutez|saisissez|écrivez|tapez|rédigez)(?: ici)? (?:votre|le|la|un|une) {PARTIE}[^.]{{0,40}}"),
    ("ceci est un|le texte de|le faux|texte de rempl|faux", r"(?:ceci est un |le )?(?:texte de remplissage|faux[- ]texte)\b[^.]{0,60}"),
    ("inserte|escriba|añada|agregue|introduzca|ponga", rf"(?:inserte|escriba|añada|agregue|introduzca|ponga)(?: aquí)? (?:su|el|la|un|una) {PARTE}[^.]{{0,40}}"),
    (_each(_PARTES, "|es|ón|ones", " por | a | para | pendiente "), rf"{PARTE} (?:por|a|para|pendiente de) (?:completar|insertar|escribir|añadir|redactar)[^.]{{0,40}}"),
    ("este es un texto|esto es texto|texto de", r"(?:este es un |esto es )?texto de (?:relleno|ejemplo|muestra|prueba)\b[^.]{0,60}"),
    ("the quick brown", r"the quick brown fox jumps over the lazy dog"),
    ("inserire|inserisci|scrivere|scrivi|testo segnaposto|questo è un testo|riassunto da|testo da", r"(?:inserire|inserisci|scrivere|scrivi) (?:qui )?(?:il |la |un )?(?:testo|riassunto|titolo|sezione|nome)\b[^.]{0,40}|(?:questo è un )?testo segnaposto\b[^.]{0,40}|(?:riassunto|testo) da (?:completare|inserire|scrivere)[^.]{0,40}"),
    ("insira|escreva|digite|texto de preenchimento|resumo a|texto a", r"(?:insira|escreva|digite) (?:aqui )?(?:o |a |seu |sua )?(?:texto|resumo|título|nome)\b[^.]{0,40}|texto de preenchimento\b[^.]{0,40}|(?:resumo|texto) a (?:completar|inserir|escrever)[^.]{0,40}"),
    ("voeg hier|vul hier|typ hier|samenvatting volgt|tekst volgt|hier komt", r"(?:voeg|vul|typ) hier (?:uw |de |je )?(?:tekst|samenvatting|titel|naam)\b[^.]{0,40}|(?:samenvatting|tekst) volgt|hier komt (?:uw |de )?(?:tekst|samenvatting)\b[^.]{0,40}"),
    ("wstaw|wpisz|tutaj wpisz|вставьте|введите|здесь будет", r"(?:tutaj )?(?:wstaw|wpisz) (?:tutaj )?(?:tekst|streszczenie|tytuł)\b[^.]{0,40}|(?:вставьте|введите) (?:здесь )?(?:текст|аннотацию|название)\b[^.]{0,40}|здесь будет (?:текст|аннотация)\b[^.]{0,40}"),
    ("在此输入|请输入|此处输入|请在此|ここに|ダミーテキスト", r"(?:请?在此处?|请|此处)输入[^。.]{0,20}|请在此[^。.]{0,20}|ここに(?:テキスト|本文|要旨|タイトル)を[^。.]{0,20}|ダミーテキスト[^。.]{0,20}"),
)

#: Stock titles and author lists of templates.
STOCK_TITLE = _any(
    r"(?:(?:insert|enter|type|your|the|sample|full|main|short|article|paper|document|manuscript|conference|preparation of) )*title(?: of (?:the |your |this )?(?:paper|article|manuscript|document|work))?(?: (?:here|goes here|text))*",
    r"untitled(?: document| paper| article)?|(?:paper|article|document|manuscript) (?:name|title)|template|new document",
    r"titel(?: (?:des|der|ihres|ihrer) (?:artikels|arbeit|aufsatzes))?|titre(?: de l'article)?|título(?: del artículo)?",
)
#: One entry of an author list: a name that stands for any, or the place of one.
STOCK_AUTHOR = _any(
    r"(?:the )?(?:first|second|third|fourth|fifth|last|other|another|main)[ -](?:[A-Z]\. )?authors?(?:'s)?(?: names?)?",
    r"authors?(?:'s)?(?: names?)?|authors? (?:one|two|three|[a-c]|\d+)|names? of (?:the )?(?:authors?|institution)|(?:author|your)(?:'s)?(?: \w+)? names?|(?:full )?names?",
    r"(?:first ?|given ?|last ?|family ?)names?(?: (?:last ?name|surname|family name))?|surname|john q?\.? ?doe|jane q?\.? ?doe|anonymous authors?",
    r"(?:name of (?:the )?)?(?:institution|department|university|organi[sz]ation|company|affiliation|institute)(?: name)?|(?:institution|department|university|organi[sz]ation|company|author|your) name|e-?mail(?: address)?|address(?: line)?(?: \d)?|city,? country",
    r"(?:erster|zweiter|dritter) autor|(?:premier|deuxième|second|troisième) auteur|(?:primer|segundo|tercer) autor|name der (?:institution|autoren)|nom de l'auteur|nombre del autor|primo autore|secondo autore",
)
_ROLE = _any(r"corresponding authors?|equal contributions?|senior author")
_THANKS = re.compile(r"\\(?:thanks|footnote|inst|orcid|email|ead|fnref|corref)\*?(?:\[[^\[\]\n]*\])?\{")
_ENTRY = re.compile(r"\\\\|\\(?:and|And|AND|newline)(?![A-Za-z])|\n|&")
_ENTRY_PART = re.compile(r"[,;()]|\band\b|\bund\b|\bet\b")
_MARKUP = re.compile(r"\\[A-Za-z]+\*?|\$[^$\n]*\$|[{}*†‡§~]|\\.")

#: Values that a program printed for something it didn't have.
NO_VALUE = _any(r"undefined", r"null", r"nan", r"\[object object\]", r"#ref!|#n/a|#value!|#name\?", r"tbd|tba|to-?do|fixme|xxx+|\?{3,}", r"nil|\(null\)|<null>|<none>|<undefined>")

STATUS = r"(?:not found|forbidden|internal server error|bad gateway|service (?:temporarily )?unavailable|gateway time-?out|too many requests|gone|unauthori[sz]ed|bad request|method not allowed|request time-?out|access denied|page not found|not acceptable|payload too large|proxy error|temporarily unavailable)"
THING = r"(?:page|site|website|item|document|article|content|resource|paper|file|record|url|link|full text|package|source|server|service|preprint|request|viewer|reader|app|application|journal)"

_THINGS = THING[3:-1]
_OF_ERRORS = "|unexpected |internal |unknown |server |database |fatal |network |application |serious |system |runtime |technical "
_OF_PAGES = "|web |full |full text |full-text |online |interactive |html |mobile |entire "

#: What a program failed to get, in messages.
WANTED = rf"(?:(?:the|this|that|your|requested|remote|any|a|an|full|external|some|required) )*(?:\w+ )?(?:{THING}|resources?|host|database|data|connection|images?|module|scripts?|stylesheet|template|library|plugin|component|version|pages?|text|content|preview|details|information|[`'\"‘“]?\S+\.\w{{2,5}}[`'\"’”]?|https?://\S+)\b"
#: What the JSON of an error tells.
_FAILED = r"(?=[^\n]*(?:error|fail|denied|forbidden|not.?found|unauthor|unavailable|exception|invalid|time-?d?.?out|expired|exceeded|too many|internal|\b[45]\d\d\b))"

#: How the lines of error messages begin. Sentences of an article that report an error begin otherwise.
ERROR = Rules(
    ("http|error|status|code|4|5", rf"(?:http(?:/\d\.\d)? ?)?(?:error|status|code)?[ :]*[45]\d\d\b[\s:.,|–—-]*(?:{STATUS}|error\b|$)"),
    (
        "not found|forbidden|internal server|bad gateway|bad request|service |gateway time|too many|gone|unauthori|method not|request time|access denied|page not|not acceptable|payload too|proxy error|temporarily un",
        rf"{STATUS}(?:[.!]?$| ?[|:] | [–—-] )",
    ),
    ("error", rf"error[ :]+(?:[45]\d\d\b|{STATUS})[^.]{{0,60}}\.?$"),
    ("<error|<?xml|<!doctype|<head|<body|<center|<div|<title|<h1", r"(?:<\?xml\b[^>]*>\s*)?<error>|<\?xml\b|<!doctype html|<(?:head|body|center|div)[^<>]*>\s*<(?:title|h1|p)>|<(?:title|h1)>"),
    ('{"|{ "', rf"\{{\s*\"(?:status|error|code|message|errors?|detail)\"\s*:{_FAILED}[^\n]*[{{\[,}}\]]$"),
    (
        "traceback|exception in|php |fatal error|parse error|warning|notice|segmentation|stack trace|at ",
        r"traceback \(most recent call last\)|exception in thread \"|(?:php )?(?:fatal error|parse error|warning|notice): {1,2}\w+\(\)|(?:php )?fatal error: |segmentation fault\b|stack trace:|at [\w.$]+\([\w.]+:\d+\)",
    ),
    (_each("an |a ", _OF_ERRORS, "error|exception|problem"), rf"an? (?:{_OF_ERRORS})(?:error|exception|problem) (?:has )?occurred(?:[.!]|$| while (?:processing|loading|retrieving|handling|rendering) (?:your|the|this) (?:request|page|document|article|paper|file|content)| (?:on|in) (?:the|this|our) (?:server|page|application))"),
    ("something went|internal error|unexpected error", r"something went wrong\b(?! (?:in|with|during|when|for) )|internal error[.:!]|unexpected error(?:[.:!]|$| occurred)"),
    ("the requested|requested", rf"(?:the )?requested (?:\w+ ){{0,3}}(?:{THING}|\S+) [^.]{{0,60}}(?:not|no longer) (?:be )?(?:found|available|exist)"),
    ("oops|sorry|whoops|uh-oh|uh oh", rf"(?:oops|whoops|uh[- ]oh)[!,.:]|sorry[!.]|sorry[,:]? (?:but )?(?:we\b|you\b|your\b|(?:this|that|the) (?:\w+ )?{THING}\b|something\b|an? (?:\w+ )?error\b|no )"),
    ("we can|we could|we were", r"we (?:can't|can not|cannot|could not|couldn't|were unable to) (?:find|load|display|retrieve|locate|process) (?:the|that|this|your) (?:\w+ ){0,2}" + THING + r"\b"),
    ("the file|file ", r"(?:the )?file [`'\"‘“]?\S+ (?:does not exist|not found|could not be (?:found|opened))"),
    ("could not|cannot|can't|failed to|unable to", rf"(?:could not|cannot|can't|failed to|unable to) (?:(?:load|retrieve|display|open|fetch|render|download|locate|find)\b(?:$| {WANTED})|(?:connect|establish)\b)"),
    (_each("your |the |this ", "session|login|token|link|subscription|trial"), r"(?:your|the|this) (?:session|login|token|link|subscription|trial) (?:has )?(?:expired|timed out|is no longer valid|is invalid)"),
    ("access to th|you don't|you do not|your ip|your request|your access", rf"access to (?:this|the) {THING}\b[^.]{{0,80}}(?:denied|restricted|forbidden|blocked)|you (?:don't|do not) have (?:permission|access)\b|your (?:ip|request|access)\b[^.]{{0,40}}(?:blocked|denied|automated|rejected)"),
    (_each("this |our |the ", "site|website|server|service|archive|page"), r"(?:this|our|the) (?:site|website|server|service|archive|page) (?:is|will be) (?:currently |temporarily )?(?:down|offline|unavailable|under maintenance|undergoing (?:\w+ )?maintenance|closed for maintenance|overloaded)"),
    (_each("this |the ", _THINGS), rf"(?:this|the) {THING}(?: \S+)? (?:is|was|has been) (?:no longer|not|temporarily|permanently|currently|moved|removed|deleted) ?(?:hosted|available|found|unavailable|here|removed|accessible|$)"),
    (_each("the ", _THINGS, " you "), rf"the {THING} you (?:are looking for|requested|were looking for|tried to)"),
    (
        "erreur|page introuvable|page non|accès|une erreur|service |" + _each("le |la |l'|l' ", "document|serveur|page|article|site"),
        r"erreur (?:interne|[45]\d\d|lors|du serveur)|la page (?:demandée|que vous)\b|page (?:introuvable|non trouvée)|(?:le|la|l') ?(?:document|serveur|page|article|site) \S* ?n'(?:est plus|existe|a pas)|accès (?:refusé|interdit)|une erreur (?:est survenue|s'est produite)|service (?:momentanément |temporairement )?indisponible",
    ),
    (
        "fehler|seite nicht|zugriff|interner|es ist ein|ein fehler|ein interner|" + _each("dieser |der ", "dienst|server") + "|" + _each("die ", "angeforderte|gewünschte|von ihnen|seite|datei|ressource"),
        r"die (?:angeforderte |gewünschte |von ihnen )?(?:seite|datei|ressource)\b[^.]{0,40}(?:nicht (?:gefunden|verfügbar)|existiert nicht)|fehler ?:? ?[45]\d\d|seite nicht gefunden|zugriff verweigert|interner serverfehler|(?:es ist )?ein (?:interner )?fehler (?:ist )?aufgetreten|(?:dieser|der) (?:dienst|server) ist (?:derzeit|vorübergehend)",
    ),
    (
        "no se |la página|página|error |acceso|se ha|ha ocurrido|ocurrió|servicio",
        r"no se puede (?:mostrar|encontrar|cargar|acceder)|(?:la )?página (?:no encontrada|solicitada|no existe)|error (?:interno|[45]\d\d|del servidor)|acceso (?:denegado|prohibido)|(?:se ha producido|ha ocurrido|ocurrió) un error|servicio (?:temporalmente )?no disponible|no se (?:encontró|ha encontrado)",
    ),
    ("pagina non|la pagina|errore|accesso|impossibile|si è verificato|servizio", r"(?:la )?pagina (?:richiesta |non )(?:non )?(?:trovata|è|esiste|disponibile)|errore (?:interno|[45]\d\d|del server)|accesso (?:negato|vietato)|impossibile (?:caricare|trovare|visualizzare) \w+|si è verificato un errore|servizio (?:temporaneamente )?non disponibile"),
    ("página não|a página|erro |acesso|não foi possível|ocorreu|serviço", r"(?:a )?página (?:não (?:foi )?encontrada|solicitada)|erro (?:interno|[45]\d\d|do servidor)|acesso (?:negado|proibido)|não foi possível (?:carregar|encontrar|exibir)|ocorreu um erro|serviço (?:temporariamente )?indisponível"),
    ("pagina niet|de pagina|de opgevraagde|fout |toegang|er is een|strona|nie znaleziono|błąd|brak dostępu|wystąpił", r"(?:de )?(?:opgevraagde )?pagina (?:is |kan )?niet (?:worden )?(?:gevonden|beschikbaar)|fout [45]\d\d|toegang geweigerd|er is een fout opgetreden|strona nie (?:została znaleziona|istnieje)|nie znaleziono strony|błąd (?:[45]\d\d|serwera|wewnętrzny)|brak dostępu|wystąpił (?:nieoczekiwany )?błąd"),
    ("страница не|ошибка|доступ|произошла|сервис|сервер", r"страница не (?:найдена|существует)|ошибка (?:[45]\d\d|сервера|доступа)|внутренняя ошибка|доступ (?:запрещен|запрещён|закрыт)|произошла (?:внутренняя )?ошибка|(?:сервис|сервер) временно недоступен"),
    ("找不到|页面不存在|无法|访问被|服务器|系统错误|出错了|您访问的|ページが|お探しの|アクセスが|サーバー|エラーが", r"(?:找不到|无法(?:显示|访问|打开|加载))[^。.]{0,12}(?:页面|网页|网站|文件|内容)|页面不存在|访问被拒绝|服务器(?:内部)?错误|系统错误|出错了|您访问的页面(?:不存在|已)|(?:お探しの)?ページが(?:見つかりません|存在しません|表示できません)|お探しのページは|アクセスが(?:拒否|禁止)|サーバー(?:内部)?エラー|エラーが発生しました"),
)
#: Lines that begin with the name of an exception, or with the address of what failed.
_RAISED = re.compile(r"[A-Za-z_.]*(?:Error|Exception): \S", re.IGNORECASE)
_ADDRESS = re.compile(r"\S+: (?=(?:this|the) )", re.IGNORECASE)

SCRIPTS = r"(?:java ?script|scripts?|scripting|js|cookies)"
#: How notices begin that scripts (or cookies) are required.
NOTICE = Rules(
    ("<noscript", r"<noscript"),
    (
        "you need|you have|you must|you will|please |to view|to read|to use|to continue|to display|to see|to run|enable|turn on|activate|allow|switch on",
        rf"(?:you (?:need|have|must|will need) (?:to )?|please |to (?:view|read|use|continue|display|see|run) [^.]{{0,60}}(?:please |you (?:need|have|must) (?:to )?)?)?(?:enable|turn on|activate|allow|switch on)\b(?: \w+){{0,3}} {SCRIPTS}\b",
    ),
    (_each("this |the |our ", _OF_PAGES, _THINGS), rf"(?:this|the|our) (?:{_OF_PAGES}){THING} (?:\w+ )?(?:requires?|needs?|uses|relies on|depends on|works? (?:best )?(?:only )?with|cannot (?:start|run|be (?:shown|displayed))|will not work|does not work)\b[^.]{{0,60}}(?:{SCRIPTS}|browser)"),
    ("this page|this site|the page|the formulas|formulas|equations", rf"(?:this|the) (?:page|site) uses \w+\. (?:formulas|equations|content)\b[^.]{{0,60}}{SCRIPTS}\b|(?:the )?(?:formulas|equations) are (?:drawn|rendered|shown|displayed) (?:by|with|using) {SCRIPTS}\b"),
    (
        "javascript|java script|script|js |cookies",
        rf"{SCRIPTS} (?:is|are|must be|seems? to be|appears? to be|has been) (?:currently )?(?:disabled|required|not enabled|turned off|switched off|blocked|needed|not supported|enabled|deactivated|unavailable)",
    ),
    ("it looks|it seems|it appears", rf"it (?:looks like|seems|appears)(?: that)? (?:your )?{SCRIPTS}\b"),
    (
        "your browser|if nothing|we need|need to|verify|just a moment|please wait|checking ",
        r"your browser (?:does not|doesn't|has|is|must|cannot|can't)\b|if nothing happens, your browser|(?:we )?need to (?:verify|confirm) (?:that )?you are (?:human|not a robot)|verify(?:ing)? you are human|just a moment\b|please wait while (?:we|your)|checking (?:if the site connection|your browser)",
    ),
    ("loading ", r"loading (?:\S+ )?(?:viewer|reader|page|document|application|app)\b(?:[.…]|$)"),
    ("bitte |aktivieren|erlauben|schalten|javascript|" + _each("diese |die ", "seite|anwendung"), r"(?:bitte )?(?:aktivieren|erlauben|schalten) sie (?:bitte )?(?:javascript|skripte|cookies|in ihrem browser)|(?:diese|die) (?:seite|anwendung) (?:benötigt|erfordert|verwendet) (?:javascript|skripte)|javascript (?:ist|muss|wird) "),
    (
        "veuillez|merci|pour |activer|autoriser|javascript|vous devez|" + _each("cette |la ", "page|application|site"),
        r"(?:veuillez |merci d'|pour [^.]{0,60}veuillez )?(?:activer|autoriser) (?:javascript|les scripts|les cookies)|(?:cette|la) (?:page|application|site) (?:nécessite|requiert|utilise) (?:javascript|les scripts)|javascript (?:est|doit|n'est) |vous devez activer javascript",
    ),
    (
        "para |debe|por favor|necesita|tiene que|habilite|active|javascript|" + _each("esta |la ", "página|aplicación"),
        r"(?:para [^.]{0,60})?(?:debe|por favor,?|necesita|tiene que) ?(?:habilitar|habilite|activar|active) javascript|(?:habilite|active) (?:javascript|los scripts|las cookies)|(?:esta|la) (?:página|aplicación) (?:requiere|necesita|utiliza) javascript|javascript (?:está|debe|no está) ",
    ),
    ("abilita|per |è necessario|occorre|questa pagina|questa applicazione|attiva|ative|habilite|para |por favor|é necessário|esta página|esta aplicação|javascript", r"(?:per [^.]{0,60})?(?:è necessario |occorre )?(?:abilita|abilitare|attiva|attivare) javascript|questa (?:pagina|applicazione) (?:richiede|utilizza) javascript|(?:para [^.]{0,60})?(?:é necessário |por favor,? )?(?:ative|ativar|habilite|habilitar) (?:o )?javascript|esta (?:página|aplicação) (?:requer|precisa de) javascript|javascript (?:è|deve|está|deve) "),
    ("schakel|zet |deze pagina|deze website|u moet|włącz|proszę|ta strona|aby |javascript", r"(?:schakel|zet) javascript (?:in|aan)\b|deze (?:pagina|website) (?:vereist|gebruikt) javascript|u moet javascript|(?:proszę |aby [^.]{0,60})?włącz(?:yć)? (?:obsługę )?javascript|ta strona wymaga (?:obsługi )?javascript|javascript (?:is|jest) "),
    ("включите|пожалуйста|для |этот |请启用|您需要|本页面|javascript|このページ|ブラウザ", r"(?:пожалуйста,? |для [^.]{0,60})?(?:включите|включить) (?:поддержку )?javascript|этот сайт требует javascript|(?:请|您需要)(?:在浏览器中)?(?:启用|开启|打开) ?javascript|本页面需要 ?(?:启用 ?)?javascript|(?:このページ(?:を表示する)?には|ブラウザの)? ?javascript ?(?:を有効に|が(?:必要|無効))|javascript (?:отключен|отключён|выключен)"),
)

#: Lines around a message that belong to the page, not to the record.
CHROME = _any(
    r"(?:\[?(?:menu|search|home|browse|help|log ?in|register|about|contact|sign in)\]?[ |·•/,]*)+",
    r"skip to (?:main )?content",
    r"cookie (?:settings|policy|preferences)|privacy policy|terms of (?:use|service)|all rights reserved\.?",
    r"(?:\(c\)|©|copyright|powered by)(?![a-z]).{0,60}|©.{0,60}",
    r"(?:</?(?:html|body|head|hr|center|div|p|br|main|section|header|footer)\b[^<>]*>\s*)+",
    r"(?:[\w-]+\.)+[a-z]{2,12}(?:[ ·|]+\d{4})?",
    r"[-=_*·. ]{1,40}",
)

#: A comment behind an even number of backslashes, of up to four; slots are none.
_COMMENT = re.compile(r"%(?:(?<!\\%)|(?<=[^\\]\\\\%)|(?<=[^\\]\\\\\\\\%))(?<![{<]%)(?![}>])(?![A-Z][A-Z0-9_]{2,}%)[^\n]*")
_BLOCK = re.compile(
    r"\\(?:(?P<off>iffalse)\b|begin\{(?P<env>comment|verbatim\*?|Verbatim|lstlisting|minted|alltt|filecontents\*?|code|listing)\}"
    r"|(?:verb|lstinline)\*?(?P<mark>[^\sA-Za-z*])[^\n]*?(?P=mark)|(?:texttt|url|path|code)(?=\{))|(?P<fence>```)"
)
_FI = re.compile(r"\\fi\b")
#: Where a block ends that is never closed.
_BREAK = re.compile(r"\n[ \t]*\n|\\(?:(?:sub)*section|chapter|end\{document\})(?![A-Za-z])")
_BIBLIOGRAPHY = re.compile(r"\\begin\{thebibliography\}.*?(?:\\end\{thebibliography\}|(?=\\(?:section|appendix|end\{document\}))|\Z)", re.DOTALL)
_ENTRIES = re.compile(r"^@\w+\{[^\n]*,\s*\n(?:[^\n]*=[^\n]*\n)*\}?", re.MULTILINE)
_HEADED = re.compile(r"\\(?<!\\def\\)(?P<headed>title|author|caption|abstract|keywords?|affiliations?|affil|address|institut(?:e|ion))\s*(?:\[[^\[\]\n]*\])?\s*\{")
_ROLES = {"title": "title", "caption": "body", "abstract": "body", "keyword": "body", "keywords": "body"}  # all others name authors
#: What a head may hold of the text itself.
_OF_HEAD = re.compile(_HEADED.pattern + r"|\\begin\{(?P<part>abstract|keywords?|IEEEkeywords|affiliations?)\}")
#: What stands in no argument; one that seems to hold it misses its brace.
_OUTSIDE = re.compile(r"\\(?:maketitle|(?:sub)*section|begin\{abstract\}|bibliography)(?![A-Za-z])")
_CUT = re.compile(
    r"\n[ \t]*\n|\\(?:end\{[^{}\n]*\}|item|maketitle|label\{[^{}\n]*\}|tableofcontents|newpage|clearpage|centering|noindent|bibliographystyle\{[^{}\n]*\}|bibliography\{[^{}\n]*\}|date\{[^{}\n]*\}|input\{[^{}\n]*\}|include\{[^{}\n]*\}|includegraphics\S*|appendix)(?![A-Za-z])"
    r"|\\begin\{(?P<env>[^{}\n]*)\}|\\(?P<heading>(?:sub)*(?:section|paragraph)|chapter)\*?[ \t]*(?:\[(?P<short>[^\[\]\n]*)\][ \t]*)?\{|"
    + _HEADED.pattern
)
_THEOREM = re.compile(r"\\(?:newtheorem|declaretheorem|newmdtheoremenv|newtcolorbox|newenvironment|newlist)\*?(?:\[[^\[\]\n]*\])?\{([^{}\n]+)\}")

# Environments with a bracketed option (any that the text declares itself has one too), those whose braced
# arguments are layout, and those without any argument.
_OPTION = re.compile(
    r"(?:(?:side|wrap|sub)?(?:figure|table)|listing|algorithm(?:ic)?|algorithm2e|tikzpicture|scope|axis|pspicture|picture|frame|block|tcolorbox|mdframed|minipage|tabular[xy]?|array|longtable|tabu|longtabu|tabularray|tblr|"
    r"threeparttable|tablenotes|adjustbox|multicols|enumerate|itemize|description|asparaenum|inparaenum|thebibliography|subequations|aligned|gathered|alignedat|[pbvBV]?matrix|cases|"
    r"theorem|lemma|proposition|corollary|definition|remark|example|proof|conjecture|claim|fact|observation|assumption|notation|note|question|problem|exercise|solution|hypothesis|axiom|property|case|"
    r"thm|lem|lemm|prop|propn|cor|coro|defn?|defi|rem|rmk|exa|exam|exmp|conj|clm|obs|assum|pf|sol)\*?"
)
_LAYOUT = re.compile(r"(?:tabular[xy]?|tabulary|array|longtable|supertabular|tabu|longtabu|tblr|minipage|multicols|wrap(?:figure|table)|adjustbox|alignat|alignedat|list|thebibliography|picture|pspicture|subarray)\*?")
_PLAIN = re.compile(r"(?:abstract|document|quote|quotation|verse|center|flushleft|flushright|keywords?|titlepage|acknowledge?ments?|equation|align|gather|multline|displaymath|math|figure|table|itemize|enumerate|description|proof)\*?")
_BRACE = re.compile(r"[{}]|\\[\\{}]")
_WORD = re.compile(r"[^\W\d_]+")
_LABEL = re.compile(r"\\label\{[^{}\n]*\}")
_BRACKET = re.compile(r"\[(?:[^\[\]\n]|\[[^\[\]\n]*\])*\]")
_PROTECTED = re.compile(r"\{[^{}_.\d]*\}")  # braces that keep the case of a heading
_VALUE = re.compile(r"=\s+\{")
_TAG = re.compile(r"<[^<>]*>")
#: A line of at most four words without a stop, as an entry of a navigation; no row of a table and no formula.
_LABELLED = re.compile(r"(?:[^\s&$\\]{1,30}(?: +|$)){0,4}(?<![.!?:;,])")
_FRAME = re.compile(r"File \".+\", line \d+|at [\w.$<>/]+\(.*\)|#\d+ .*\(|\.\.\. \d+ more|Caused by: |(?:During handling of|The above exception)\b|[~^]+$|\[Previous line repeated")
_SENTENCE = re.compile(r"(?<=[.!?:])\s+|\n+")


#: Braces among which the end of an argument is looked for before all of the text are matched.
NEAR = 200


def _braces(text: str) -> dict[int, int]:
    """Where each opening brace that is closed is closed, from one pass over all braces that are not escaped."""
    closed, opened = {}, []
    for found in _BRACE.finditer(text):
        if found.group() == "{":
            opened.append(found.start())
        elif found.group() == "}" and opened:
            closed[opened.pop()] = found.start()
    return closed


class _Closing:
    """Where the braces of a text close. A near end is looked for from its brace; the first far one makes the map of all."""

    def __init__(self, text: str):
        self.text, self.all = text, None

    def get(self, at: int, default: int | None = None) -> int | None:
        if self.text[at : at + 1] != "{":
            return default
        if self.all is None:
            depth = 0
            for count, found in enumerate(_BRACE.finditer(self.text, at)):
                if found.group() == "{":
                    depth += 1
                elif found.group() == "}":
                    depth -= 1
                    if not depth:
                        return found.start()
                if count == NEAR:
                    break
            else:
                return default
            self.all = _braces(self.text)
        return self.all.get(at, default)


def _outside(text: str) -> list[int]:
    return [found.start() for found in _OUTSIDE.finditer(text)]


def _without_blocks(text: str) -> str:
    """``text`` without skipped blocks and code. A block that is never closed ends with its paragraph."""
    out, at, never, braces = [], 0, set(), None
    while found := _BLOCK.search(text, at):
        out.append(text[at : found.start()])
        at = found.end()
        closing = "\\fi" if found["off"] else "```" if found["fence"] else found["env"] and f"\\end{{{found['env']}}}"
        if closing:
            end = -1
            if closing not in never:
                if found["off"]:
                    close = _FI.search(text, at)
                    end, behind = (close.start(), close.end()) if close else (-1, at)
                else:
                    end = text.find(closing, at)
                    behind = end + len(closing)
            if end < 0:
                never.add(closing)
                close = _BREAK.search(text, at)
                behind = close.start() if close else len(text)
            at = behind
        elif not found["mark"]:
            if braces is None:
                braces = _Closing(text)
            end = braces.get(at, -1)
            if end < 0 or "\n" in text[at:end]:
                out.append(found.group())  # no code: the argument spans lines or isn't closed
            else:
                at = end + 1
        out.append(" ")
    return "".join(out) + text[at:]


def visible(text: str) -> str:
    """``text`` as set: without comments, skipped blocks, code, bibliography and what follows the end of the document; line
    ends as newlines."""
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    if "%" in text:
        text = re.sub(r"(?m)^[ \t]*(?<!\\)%(?![A-Z][A-Z0-9_]{2,}%)[^\n]*\n?", "", text)
    text = _without_blocks(text)
    if "%" in text:
        text = _COMMENT.sub("", text)
    if "\\begin{thebibliography}" in text:
        text = _BIBLIOGRAPHY.sub("\n", text)
    begin = text.find("\\begin{document}")
    if begin >= 0 and (end := text.find("\\end{document}", begin)) >= 0:
        text = text[:end]
    return _ENTRIES.sub("\n", text) if "@" in text else text


def passages(text: str) -> Iterator[tuple[str, str]]:
    """(role, passage) of a text made visible: title, author, affiliation, keywords, and each heading, caption and paragraph of
    abstract and body. All but headings and paragraphs of the body may stand in the head, whose macros aren't read.

    Only commands are cut out: the argument of a heading is a passage of its own, what follows it on its line belongs to the
    next one. A bracket behind \\begin is an option where the environment takes one, else text.
    """
    start = text.find("\\begin{document}")
    head = text if start < 0 else text[:start]
    body = text if start < 0 else text[start + 16 :]
    if start < 0:
        if "\\documentclass" in body:
            body = re.sub(r"(?m)^\\(?:documentclass|usepackage|(?:re)?newcommand|DeclareRobustCommand|def|input)\b[^\n]*$", "", body)
    else:
        closed, outside, behind = _Closing(head), _outside(head), 0
        while found := _OF_HEAD.search(head, behind):
            if found["part"]:
                end = head.find(f"\\end{{{found['part']}}}", found.end())
                argument, behind = (head[found.end() : end], end) if end >= 0 else (head[found.end() :], len(head))
            else:
                argument, behind = _argument(head, found.end(), closed, outside)
            yield from _headed(found["part"] or found["headed"], argument)
    declared = set(_THEOREM.findall(text)) if "\\new" in text or "\\declare" in text else set()
    closed, outside, at, behind = _Closing(body), _outside(body), 0, 0
    while True:
        found = _CUT.search(body, behind)
        piece = body[at : found.start() if found else len(body)]
        if piece and not piece.isspace():
            yield "body", piece.strip()
        if not found:
            return
        at = behind = found.end()
        if found["headed"]:
            argument, at = _argument(body, at, closed, outside)
            behind = at
            yield from _headed(found["headed"], argument)
        elif found["heading"]:
            end = closed.get(at - 1)
            if found["short"]:
                yield "heading", found["short"]
            if end is not None:  # else the text behind the open brace is read with the passage
                yield "heading", _LABEL.sub(" ", body[at:end])
                at = behind = end + 1
        elif found["env"] is not None:
            for argument, at in _arguments(body, found["env"], at, declared, closed):
                behind = at
                if argument and "=" not in argument:
                    yield "heading", argument


def _headed(command: str, argument: str) -> Iterator[tuple[str, str]]:
    """The passages of an argument or environment; affiliations may be written as keys with braced values."""
    role = _ROLES.get(command.lower().removeprefix("ieee"), "author")
    if command in ("title", "author", "caption"):
        yield role, argument
        return
    at = 0
    for found in _CUT.finditer(argument):
        yield role, _VALUE.sub("={", argument[at : found.start()])
        at = found.end()
    yield role, _VALUE.sub("={", argument[at:])


def _argument(text: str, at: int, closed: _Closing, outside: list[int]) -> tuple[str, int]:
    """The text of a braced argument that begins at ``at``, and its end; a missing brace ends it with the line."""
    end = closed.get(at - 1)
    if end is not None and bisect(outside, at) == bisect(outside, end):
        return text[at:end], end + 1
    end = text.find("\n", at)
    return text[at : end if end >= 0 else len(text)], end if end >= 0 else len(text)


def _arguments(body: str, env: str, at: int, declared: set[str], closed: _Closing) -> Iterator[tuple[str | None, int]]:
    """(text, end) of each argument behind the \\begin of ``env``, null for layout; what is no argument is part of the passage."""
    layout = _LAYOUT.fullmatch(env)
    option = layout or env in declared or _OPTION.fullmatch(env)
    braced = layout or not _PLAIN.fullmatch(env)
    while True:
        if option and (found := _BRACKET.match(body, at)):
            at = found.end()
            yield (None if layout else found.group()[1:-1]), at
        elif braced and (end := closed.get(at)) is not None and (layout or body[at + 1] != "{"):
            begin, at = at + 1, end + 1
            yield (None if layout else body[begin : at - 1]), at
        else:
            return


def _full(pattern: re.Pattern, text: str) -> bool:
    return bool(pattern.fullmatch(text.strip().rstrip(".!:").strip()))


def _slots(passage: str, role: str) -> bool:
    """Whether unfilled slots make up a passage. Those in quotes are quoted; among several words on syntax they are examples."""
    if not _OPENING.search(passage):
        return False
    held = [m for m in SLOT.finditer(passage) if not (passage[: m.start()].endswith(_QUOTES) and passage[m.end() :].startswith(_UNQUOTES))]
    if not held:
        return False
    left = SLOT.sub(" ", passage)
    rest = _WORD.findall(left)
    words = len(rest)
    if words >= 2 * len(held) and words > 2 and _SYNTAX.search(left):
        return False
    if role in ("title", "author"):
        return True
    inside = sum(len(m.group()) for m in held)
    loose = sum(m.group()[0] == "{" and m.group()[:2] not in ("{{", "{%") for m in held)
    return (words <= 2 * len(held) and inside >= 5) or (loose >= 2 and words <= 8 * loose) or (len(held) > loose and words <= 12 * (len(held) - loose))


def _filler(passage: str) -> bool:
    lines = [line.strip() for line in passage.split("\n") if line.strip()]
    if any(_FILLER_LINE.fullmatch(line) for line in lines):
        return True
    words = _WORD.findall(passage.lower())
    typed = [w for w in words if w in TYPED or _ONE_LETTER.fullmatch(w)]
    if len(typed) == len(words) > 0 and (len(words) >= 3 or len(words[0]) >= 10 or not KEYS.isdisjoint(words)) and any(w not in TYPED_WORDS for w in words):
        return True
    if len(words) >= 8 and len(typed) >= 0.9 * len(words) and sum(w not in TYPED_WORDS for w in typed) >= 0.3 * len(words):
        return True
    return len(words) >= 4 and bool(_LATIN.search(passage)) and sum(w in LOREM for w in words) >= 0.65 * len(words)


def _names_no_one(authors: str) -> bool:
    """Whether an entry of an author list is a stock one. Its first part counts: what follows a name is its role or place."""
    found = _THANKS.search(authors)
    if found:
        closed, kept, at = _braces(authors), [], 0
        while found:
            kept.append(authors[at : found.start()])
            at = closed.get(found.end() - 1, found.end() - 1) + 1
            found = _THANKS.search(authors, at)
        authors = "".join(kept) + authors[at:]
    stock, others = False, False
    for entry in _ENTRY.split(authors):
        parts = [" ".join(_MARKUP.sub(" ", part).split()).strip(" .:0123456789") for part in _ENTRY_PART.split(entry)]
        parts = [part for part in parts if part]
        if not parts:
            continue
        if STOCK_AUTHOR.fullmatch(parts[0]):
            return True
        stock, others = stock or bool(_ROLE.fullmatch(parts[0])), others or not _ROLE.fullmatch(parts[0])
    return stock and not others


#: What a phrase may be part of: filler, an instruction, a message.
_FILL, _TELL, _SAY = 1, 2, 4


@lru_cache(maxsize=1)
def _phrases() -> ahocorasick.Automaton:
    """What the rules need to find in a passage whose sentences are lines: which of _FILL, _TELL and _SAY the phrase belongs to."""
    kinds: dict[str, int] = {}
    for rules, kind in ((INSTRUCTION, _TELL), (ERROR, _SAY), (NOTICE, _SAY)):
        for head in rules.heads:
            kinds[f"\n{head}"] = kinds.get(f"\n{head}", 0) | kind
    for word in ("error:", "exception:", "<style", "<script", "<!--"):
        kinds[word] = _SAY
    for word in (*_FILLER_NAMES, "xxx", *(letter * 5 for letter in ascii_lowercase)):
        kinds[word] = _FILL
    for word in (*_LATIN_WORDS, *(TYPED - TYPED_WORDS)):
        kinds[f" {word}"] = kinds[f"\n{word}"] = _FILL
    found = ahocorasick.Automaton()
    for phrase, kind in kinds.items():
        found.add_word(phrase, kind)
    found.make_automaton()
    return found


def _mentioned(passage: str) -> int:
    """The kinds of phrases that occur in ``passage``, as bits."""
    lower = passage.lower()
    lower = "\n".join(" ".join(line.split()) for line in lower.split("\n")) if "\n" in lower else " ".join(lower.split())
    for end in ".!?:":
        lower = lower.replace(f"{end} ", f"{end}\n")
    kinds = 0
    for _, kind in _phrases().iter("\n" + lower):
        kinds |= kind
    return kinds


def judge(passage: str, role: str = "body") -> str | None:
    """The kind of residue that a passage is (placeholder, filler, error, notice), or null for content."""
    text = passage.strip()
    if role == "heading" and _PROTECTED.fullmatch(text):
        text = text[1:-1]
    if not text:
        return None
    if role == "title" and (_full(STOCK_TITLE, text) or _full(NO_VALUE, text)):
        return "placeholder"
    if role == "author" and (_names_no_one(text) or _full(NO_VALUE, text)):
        return "placeholder"
    if _slots(text, role) or (text[0] in _BRACKETS and BRACKETED.match(" ".join(text.split()))):
        return "placeholder"
    kinds = _mentioned(text)
    if kinds & _FILL and _filler(text):
        return "filler"
    lines = [line for raw in text.split("\n") if (line := raw.strip())]
    if any(line[0] in _BRACKETS and BRACKETED.match(line) for line in lines):
        return "placeholder"
    if kinds & (_TELL | _SAY) == 0 and len(lines[0]) > 40:
        return None  # neither a rule on sentences nor one on short lines can hold
    told = [line for line in lines if not CHROME.fullmatch(line)]
    if not told:
        return None
    if all(_full(NO_VALUE, line) for line in told) and (role != "body" or not re.fullmatch(r"(?i)tba|xxx+|\?+", told[0])):
        return "placeholder"
    if kinds & _TELL:
        sentences = [s for line in told for s in _SENTENCE.split(line) if s.strip()]
        whole = sum(map(len, sentences))
        if _share(((len(s), s) for s in sentences), 0.6 * whole, whole, _instructed):
            return "placeholder"
    if role == "heading" and re.fullmatch(STATUS, text, re.IGNORECASE):
        return None  # the name of a topic
    if not kinds & _SAY or re.search(r"\\(?:cite|ref|eqref)", text):
        return None
    return _message(text)


def _share(weighed: Iterable[tuple[int, T]], least: float, whole: int, share: Callable[[T], float]) -> bool:
    """Whether parts with their ``share`` hold ``least`` of ``whole``; the heaviest go first, and it ends when that is settled."""
    held, left = 0.0, float(whole)
    if not whole:
        return False
    for weight, part in sorted(weighed, key=itemgetter(0), reverse=True):
        if held >= least or held + left < least:
            break
        held, left = held + weight * share(part), left - weight
    return held >= least


def _instructed(sentence: str) -> float:
    """1 for an instruction; for several in a row without stops between them the share that they take."""
    sentence = sentence.strip()
    if INSTRUCTION.match(sentence.rstrip(".!:").strip(), full=True):
        return 1.0
    held, count, found = 0, 0, INSTRUCTION.match(sentence)
    while found:
        held, count = held + len(found.group()), count + 1
        found = INSTRUCTION.anywhere.search(sentence, max(found.end(), found.start() + 1))
    return held / len(sentence) if count > 1 or held >= 0.85 * len(sentence) else 0.0


def _kind(line: str) -> str | None:
    if ERROR.match(line) or _RAISED.match(line):
        return "error"
    if NOTICE.match(line):
        return "notice"
    address = _ADDRESS.match(line)
    return _kind(line[address.end() :]) if address else None


def _message(text: str) -> str | None:
    """error or notice, if a message leads ``text`` or takes half of what it tells; its length doesn't matter.

    A message leads if it is among the first three lines that tell something: tags, styles, scripts, page chrome and the
    short labels of a navigation don't. Lines of a stack trace and code below them belong to their message.
    """
    lines, parts, frame, told, leading = _shown(text), [], False, 0, True
    for raw in lines:
        line = raw.strip()
        if not line or CHROME.fullmatch(line):
            continue
        if leading and (kind := _kind(line)):
            return kind
        words = _TAG.sub(" ", line) if "<" in line else line
        label = _LABELLED.fullmatch(words.strip()) is not None
        if not label:
            told += 1
            leading = told < 3
        belongs = bool(_FRAME.match(line)) or (frame and raw[:1].isspace())
        frame = belongs
        parts.append((len(words.strip()), (line, belongs)))
    if leading:
        return None  # all lines were looked at
    kinds: list[str] = []

    def share(part: tuple[str, bool]) -> float:
        kind = _kind(part[0])
        if kind:
            kinds.append(kind)
        return 1.0 if kind or part[1] else 0.0

    whole = sum(weight for weight, _ in parts)
    if not _share(parts, 0.5 * whole, whole, share):
        return None
    return kinds[0] if kinds else next(filter(None, (_kind(line) for _, (line, _) in parts)), None)


def _shown(text: str) -> list[str]:
    """The lines of ``text`` without the styles, scripts and comments of a page, as far as these are closed. An object in braces
    is one line."""
    if text[0] == "{" and text[-1] == "}":
        return [" ".join(text.split())]
    for opening, closing in (("<style", "</style>"), ("<script", "</script>"), ("<!--", "-->")):
        if opening not in text.lower():
            continue
        lower, out, at = text.lower(), [], 0
        while (begin := lower.find(opening, at)) >= 0 and (end := lower.find(closing, begin)) >= 0:
            out.append(text[at:begin])
            at = end + len(closing)
        text = "".join(out) + text[at:]
    return text.split("\n")


def residue(text: str | None) -> str | None:
    """The kind of the first residue in ``text``, or null: a null, empty or blank text has none."""
    if not text or text.isspace():
        return None
    for role, passage in passages(visible(text)):
        kind = judge(passage, role)
        if kind:
            return kind
    return None


def residue_kind(text: Column) -> Column:
    """placeholder, filler, error or notice where such text stands in place of content; null elsewhere."""

    @F.pandas_udf("string")
    def apply(texts: pd.Series) -> pd.Series:
        return texts.map(residue, na_action="ignore").astype(object)

    return apply(text)


def find_residue(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, kind) of the records that hold residue; whole texts are read. Null and repeated keys are rows like others.

    Null, empty and blank texts hold none. Other columns of ``df`` are ignored.
    """
    return df.select(key, residue_kind(F.col(text)).alias("kind")).where("kind is not null")


def without_residue(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` without the records that hold residue; null, empty and blank texts stay, as all columns do."""
    return df.where(residue_kind(F.col(text)).isNull())
