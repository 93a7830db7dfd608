"""Fields that show a template, filler, an error message or a script notice.

Two families of expressions, all evaluated inside the JVM:

* placeholders, one grammar per delimiter (``{{ }}``, ``{% %}``, ``<% %>``, ``%% %%``,
  ``[[ ]]``, ``${ }`` ...), found anywhere in the field;
* messages, patterns that must start the field, a sentence or a part between
  separators, and fill it: of the words up to its end at most ``STRANGE`` may be
  neither function words nor words of such messages.  A text *about* errors or scripts
  goes on with words of its own subject, a message doesn't.

A field is discounted when it writes about such things: code between backticks or
code tags is taken out first, and where words of a tutorial stand beside a
placeholder that fills less than half of the field, the placeholder is an example.
Null and blank fields are never cases.  The patterns are written from the public
syntax of template engines and the stock messages of servers, frameworks and browsers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelens.llm.spam_features import FUNCTION_WORDS

_FIELD = "(?:title|headline|subline|heading|subtitle|name|brand|store|shop|site|company|product|category|city|location|keyword|price|year|month|date|author|topic|text|summary|excerpt|description|desc|content|image|link|url|number|variant|sku)"

#: Placeholder grammars by opening delimiter.
PLACEHOLDERS = [
    r"\{\{[^{}]*+\}\}",
    r"\{[%#][^{}]*[%#]\}",
    r"[$#@]\{\s*\w[^{}]*+\}",
    r"(?<![\w$#@{])\{[a-z_][\w.\-]{0,60}\}(?!\})",
    r"(?<![\w$#@{])\{\d{1,2}(?::[^{}]{0,10})?\}(?!\})",
    r"<%(?:[^%<]|%(?!>)|<(?!%))*+%>",
    r"<\?(?:php|=)(?:[^?]|\?(?!>))*+(?:\?>|$)",
    r"\[\[[^\[\]]++\]\]",
    rf"\[(?:{_FIELD}|(?:insert|your|enter)[^\[\]]{{1,40}}|[a-z]+(?:_[a-z]+){{1,12}})\]",
    rf"(?<!\w)<{_FIELD}>(?!\w)",
    r"%%\w{1,60}%%",
    r"(?<![\w%])%[a-z_]{2,40}%(?![\w%])",
    r"(?<![\w%])%(?:\d\$)?[sd](?![\w%])",
    r"(?<!\w)__[a-z0-9]+(?:_[a-z0-9]+){0,12}__(?!\w)",
    r"(?<![\w$])\$[a-z_]+\$(?![\w$])",
    r"(?<!\S)@(?:model|viewbag|viewdata|html|page|site|item)\.\w+",
]

_KEYS = r"(?:asdf|qwerty|qwertz|azerty|foo|bar|baz|blah|bla)\w{0,4}+"
_NOTHING = r"(?:undefined|null|nan|none|n/a|\[object object\])"

#: A field that consists of a constant's name, bare markup or repeated keys.
WHOLE = [
    r"(?:page|meta|seo|site|og|product|category)?_?(?:title|description|desc|headline|name)_(?:tag|text|here|placeholder|value|key)(?:_?\d+)?",
    r"</?[a-z][a-z0-9]*\s*/?>",
    r"x{3,}+(?:\W*?x{3,}+)*+\W*",
    rf"{_KEYS}(?:\W*?{_KEYS})++\W*",
    r"test(?:\W*?test)++\W*\d*",
    r"([a-z])\1{2,}+\W++([a-z])\2{2,}+(?=\W)(?:\W++([a-z])\3{2,}+)*+\W*[a-z]*",
    rf"{_NOTHING}(?:\W*?{_NOTHING})*+\W*",
    r"[(\[]?(?:no|ohne|sans|sin|sem|brak|без) ?(?:title|titel|titre|t[ií]tulo|tytu[łl]u|заголовка|name|description|beschreibung)[)\]]?",
    r"(?:loading|laden|chargement|cargando|carregando|ładowanie|загрузка|読み込み中)\W*",
    r"(?:copy of ){0,6}(?:untitled|unbenannt|sans titre|sin t[ií]tulo|sem t[ií]tulo|без названия|無題)(?: (?:document|page|dokument|seite|\d+)){0,6}",
    r"(?:copy of ){1,6}.{0,40}\d*",
    r"(?:new|sample|blank|default|test|example|neue|nouvelle|nueva|nova|nowa|новая) (?:page|seite|página|pagina|strona|страница|post|document|title)(?: \d+)?",
    r"(?:dummy|sample|filler|placeholder|example|default) (?:headline|heading|text|title|content|copy|description)(?: \d+)?",
    r"(?:blindtext|fülltext|beispieltext|platzhaltertext|platzhalter)(?: [\p{L}]+)?(?: \d+)?",
    r"(?:texte (?:d'exemple|factice|de remplissage)|texto de (?:ejemplo|relleno|exemplo|preenchimento)|tekst (?:zastępczy|przykładowy)|текст-заполнитель|пример текста|ダミーテキスト|サンプルテキスト)(?: \d+)?",
    r"(?:nan|null|undefined|\[object object\])\W+(?:results?|items?|products?|ergebnisse)\b.{0,60}",
]

#: Messages that begin a field or a sentence.
OPENERS = [
    # filler and default texts
    r"lorem ipsum",
    r"(?:insert|enter|add|write|type|put|provide|describe) (?:(?:your|a|an|the|our|this|short|brief|new|page|meta|seo|site) ?){0,6}(?:title|headline|description|summary|text|content|name|page)\b.{0,60}(?:here|characters\)?|sentences|page here|below)",
    r"(?:your |the |page |meta |seo ){0,6}(?:title|headline|description|desc|summary|text|tagline|content) (?:goes |comes |to go |will be )?here",
    r"(?:dies|das|hier) ist (?:ein|nur ein|der) (?:blindtext|platzhalter|beispieltext|mustertext|dummytext)",
    r"(?:ceci est|esto es|este es|isto é|este é|to jest|это) (?:un |um |nur )?(?:texte (?:factice|d'exemple|de remplissage)|texto de (?:ejemplo|relleno|prueba|exemplo|preenchimento)|tekst (?:zastępczy|przykładowy)|(?:пример|тестовый) текст)",
    r"this is (?:a |an |just |some ){0,6}(?:dummy|sample|placeholder|filler|example|default) (?:text|page|description|content|title)",
    r"todo\b:? ?(?:seo|write|add|title|description|text|meta|insert|fill)",
    r"(?:n/a|tbd|tba|tbc)\b\W{0,3}(?:to be|$)",
    r"(?:another|just another|a) (?:new )?(?:site|blog|website|shop) (?:powered|built|made) (?:by|with)",
    r"just another \w+ (?:site|blog)",
    r"welcome to (?:your|our) new (?:web ?server|web ?site|site|blog|shop|store)",
    r"(?:this|the) (?:domain|site|website) (?:is|has been) (?:parked|for sale|suspended)",
    r"hello world\W*$",
    r"(?:seiten)?(?:titel|beschreibung|text|überschrift)\b.{0,20}hier (?:eingeben|einfügen|einsetzen)",
    r"hier (?:steht|kommt|folgt) (?:die|der|das|ein|eine|ihr|ihre) (?:beschreibung|titel|text|überschrift|inhalt|meta)",
    r"(?:titre|description|texte)\b.{0,30}à (?:compléter|remplir|rédiger)",
    r"(?:ajoutez|insérez|saisissez|entrez|écrivez)(?: ici)? (?:votre|un|une|le|la) (?:titre|description|texte|résumé)",
    r"(?:texto de (?:relleno|ejemplo|exemplo|preenchimento)|texte de remplissage|tekst zastępczy)\b.{0,60}",
    r"(?:inserte|introduzca|escriba|añada|insira|digite|escreva|adicione) (?:aquí |aqui )?(?:el|la|su|un|una|o|a|seu|sua|um|uma) (?:título|descripción|descrição|texto|resumen|resumo)",
    r"(?:wpisz|wstaw|dodaj|wprowadź) (?:tutaj |tu )?(?:tytuł|opis|tekst)",
    r"(?:введите|вставьте|добавьте) (?:здесь )?(?:заголовок|название|описание|текст)",
    r"(?:ここに|こちらに).{0,10}(?:タイトル|説明|テキスト|文章)",
    # errors of servers, frameworks and the site
    r"(?:http |error |erreur |fehler |err[:.]? |status |code ){0,4}(?:0x[0-9a-f]+|[1-9]\d{2,3})\W{0,4}(?:\(?(?:page |file )?not found|forbidden|unauthorized|bad request|bad gateway|gateway time-?out|request time-?out|internal server error|service (?:temporarily )?unavailable|too many requests|method not allowed|not acceptable|conflict|gone|payment required)\b",
    r"(?:http )?(?:error|status|code)(?: code)? (?:0x[0-9a-f]+|\d{3,4})\b\W{0,4}(?:$|[(:–—-]? ?\(?(?:not found|request blocked|forbidden|access denied|server error|bad|the request|this page))",
    r"(?:too many requests|internal server error|bad gateway|gateway time-?out|service unavailable|request blocked|access (?:is )?denied|permission denied|forbidden|connection refused)\b\W*(?:\(?\d*\)?\W*)?(?:$|\|)",
    r"(?:the |this |that )?(?:requested )?(?:page|url|file|resource)(?: you (?:requested|are looking for|were looking for))? (?:not found|could not be found|can ?not be found|can[’']t be found|was not found|does not exist|doesn[’']t exist|no longer exists)",
    r"(?:oops|whoops|uh oh|sorry)\b\W{0,3}.{0,40}(?:can[’']t be found|not found|went wrong|error (?:has )?occurred|wrong page)",
    r"(?:an |a |sorry, an |unexpected |unknown ){0,6}(?:error|exception|problem) (?:has )?occurred",
    r"something went wrong",
    r"error establishing a database connection",
    r"(?:php )?(?:fatal|parse|syntax|runtime|application|server|database|critical) error\b\W",
    r"(?:php )?(?:warning|notice|deprecated): .{3,120}(?: in /| on line |undefined|deprecated)",
    r"notice: trying to get property",
    r"uncaught (?:type|reference|syntax|range|exception)\w*",
    r"(?:err|error)\b\W{1,3}(?:template|module|file|theme|plugin|view|include)\b.{0,40}(?:could not|cannot|failed|missing|not)",
    r"traceback \(most recent call last\)",
    r"(?:java|javax|org|com|system|kotlin)(?:\.\w{1,60}){1,12}(?:exception|error)\b",
    r"sqlstate\[",
    r"stack ?trace\b\W",
    r"session (?:has )?(?:expired|timed out)",
    r"(?:your )?(?:request|connection|session) (?:has )?timed out",
    r"(?:your )?(?:request|access|ip)(?: address)? (?:has been|was) (?:blocked|denied|rejected)",
    r"you (?:don[’']t|do not) have (?:the )?(?:permission|access|sufficient)",
    r"(?:the |this |our )?(?:site|page|shop|store|website|we)(?: is| are)? ?(?:currently |temporarily |now )?(?:under|down for|in|undergoing) (?:scheduled )?maintenance",
    r"(?:under construction|coming soon)\W*$",
    r"maintenance mode\W*$",
    r"(?:die )?(?:angeforderte )?(?:seite|datei|url)(?: wurde)? (?:nicht gefunden|existiert nicht|konnte nicht gefunden)",
    r"(?:page|fichier) (?:introuvable|non trouvée)|(?:la )?page (?:demandée )?(?:n[’']existe (?:pas|plus)|est introuvable)",
    r"nous n[’'](?:avons pas pu|arrivons pas à) trouver",
    r"(?:la )?página (?:que (?:busca|buscas) )?(?:no (?:existe|encontrada|se encuentra|disponible))|no se (?:ha )?(?:encontró|encontrado|pudo encontrar)",
    r"(?:a )?página (?:que (?:procura|você procura) )?(?:não (?:existe|encontrada|foi encontrada))",
    r"(?:nie znaleziono|nie można znaleźć) (?:strony|pliku)|(?:ta )?strona (?:nie istnieje|nie została znaleziona)",
    r"(?:запрашиваемая |эта )?страница (?:не найдена|не существует|удалена)|ошибка (?:сервера|\d{3})|доступ (?:запрещен|запрещён)",
    r"(?:お探しの)?ページ(?:が|は)(?:見つかりません|存在しません)|エラーが発生しました|アクセスが拒否",
    r"(?:accès refusé|zugriff verweigert|acceso denegado|acesso negado|odmowa dostępu|brak dostępu)\W*(?:$|\|)",
    r"(?:interner serverfehler|erreur interne|error interno|erro interno|błąd serwera|erreur \d{3}|fehler \d{3}|błąd \d{3})\b",
    # scripts and browser checks
    r"(?:please |you (?:need|have) to |you must ){0,6}(?:enable|activate|turn on|allow) (?:java ?script|cookies|scripts)\b",
    r"java ?script (?:is |must be |has to be ){0,6}(?:required|disabled|not enabled|deactivated|turned off|enabled to)\b",
    r"(?:this|our|the) (?:site|page|app|application|website|shop|store|content) (?:requires?|needs?|works? best with|cannot run without) (?:java ?script|cookies|scripts)",
    r"(?:we[’']re |we are )?sorry,? but .{1,60}(?:without|requires?) (?:java ?script|scripts)",
    r"your browser (?:does not|doesn[’']t|is|must|has)\b.{0,80}(?:java ?script|supported|cookies|outdated|disabled|support)",
    r"(?:just a moment|one moment,? please|please wait)\W*(?:$|\||while)",
    r"(?:checking|verifying) (?:your browser|if the (?:site )?connection is secure|that you are|you are (?:a )?human)",
    r"(?:verify|confirm) (?:that )?you are (?:a )?(?:human|not a robot)",
    r"(?:attention required|are you (?:a )?(?:robot|human))\W",
    r"(?:ddos protection by|performance (?:&|and) security by)",
    r"java ?script ist (?:deaktiviert|erforderlich|nicht aktiviert)|bitte (?:aktivieren|erlauben) sie (?:java ?script|cookies)|(?:bitte warten|einen moment)\b.{0,6}(?:browser|$)|(?:ihr )?browser wird (?:über|ge)prüft",
    r"(?:veuillez )?(?:activez|activer) (?:java ?script|les cookies)|java ?script (?:est|doit être) (?:désactivé|requis|nécessaire|activé)|(?:un instant|vérification de votre navigateur)\W*",
    r"(?:por favor,? )?(?:active|activa|habilite|habilita|ative|ativa) (?:o |el )?java ?script|java ?script (?:está|es|é) (?:desactivado|desativado|necesario|necessário|obligatorio|obrigatório)|(?:un momento|comprobando su navegador|verificando (?:su|seu|o) navegador)\W*",
    r"(?:proszę )?(?:włącz|włączyć|włączenie) (?:obsługę )?java ?script|java ?script jest (?:wyłączony|wymagany)",
    r"(?:пожалуйста, )?(?:включите|активируйте|разрешите) (?:поддержку )?java ?script|java ?script (?:отключен|отключён|выключен)|проверка браузера",
    r"java ?script ?(?:を|が)(?:有効|無効|必要)|ブラウザ(?:を|の)(?:確認|チェック)|少々お待ちください\W*$",
]

#: Words of a text that explains templates, code or type specimens.
_TUTORIAL = (
    r"\b(?:tutorial|explained|syntax|placeholders?|in css|in html|in php|in liquid|jinja|handlebars|mustache|cheat ?sheet|variables?|escap(?:e|ing)|specimens?|snippet|coding|lesson|course|developers?)\b"
    r"|(?U)\b(?:vorlagen?|platzhalter|anleitung|variablen|lektion|gabarits?|modèles?|syntaxe|guide|leçon|plantillas?|variables|sintaxis|lección|curso|modelos?|sintaxe|lição|szablon\w*|zmienn\w+|składni\w*|шаблон\w*|переменн\w+|синтаксис\w*|урок\w*)\b"
    r"|テンプレート|変数|構文|講座"
)
#: Strange words that a message may hold (the name of a site), and characters of a Japanese one.
STRANGE, LONGEST_JAPANESE = 1, 24
# Words that messages of sites, servers, browsers and editors consist of, beside function words.
MESSAGE_WORDS = (
    "error err code status page site website blog shop store server application app file url resource address request requested requests response browser connection session access domain script scripts javascript java cookies "
    "please sorry oops whoops uh oh enable enabled activate disabled deactivated turn turned off allow allowed support supported supports need needs required requires require work works properly run view display see show continue again try "
    "reload refresh back later log login sign wait moment seconds minutes loading load loaded processing performing occurred happened went wrong something unexpected unknown problem exception found find exist exists longer available unavailable looking bad gateway "
    "forbidden denied blocked rejected permission sufficient resource expired timed time timeout internal many few service temporarily currently maintenance scheduled undergoing down soon coming construction check checking verify verifying verification secure security human robot "
    "incident ref id reference administrator contact establishing database fatal parse runtime critical notice trying property line undefined null template module theme plugin view include traceback recent call last stack trace "
    "insert enter add write type put provide describe title headline description desc summary text content tagline meta seo short brief sentences one two max characters here goes new another powered built made builder welcome web parked sale suspended dummy sample placeholder filler example default replaced todo tbd filled editor "
    "seite seitentitel titel beschreibung überschrift inhalt angeforderte gefunden existiert mehr bitte warten aktivieren erlauben deaktiviert erforderlich geprüft fehler zugriff verweigert blindtext platzhalter beispieltext später ersetzt eingeben einfügen steht ihrem "
    "page introuvable trouvée trouver demandée existe pu veuillez activer activez afficher contenu navigateur vérification erreur accès refusé compléter remplir titre ajoutez ici texte résumé "
    "página encontrada encuentra busca activar navegador habilite active error acceso denegado relleno ejemplo sustituir antes publicar aquí título descripción descrição encontrado negado "
    "strona strony strony znaleziono istnieje włącz włączyć obsługę przeglądarce błąd odmowa dostępu wpisz tytuł opis tekst страница найдена существует удалена включите активируйте браузере ошибка доступ запрещен запрещён введите описание"
).split()
# Words of the customary pseudo-Latin filler text.
LOREM_WORDS = (
    "lorem", "ipsum", "dolor", "amet", "consectetur", "adipiscing", "elit", "eiusmod", "tempor", "incididunt", "labore", "dolore",
    "magna", "aliqua", "enim", "minim", "veniam", "quis", "nostrud", "exercitation", "ullamco", "laboris", "nisi", "aliquip", "commodo",
    "consequat", "duis", "aute", "irure", "reprehenderit", "voluptate", "velit", "esse", "cillum", "fugiat", "nulla", "pariatur",
    "excepteur", "sint", "occaecat", "cupidatat", "proident", "sunt", "culpa", "officia", "deserunt", "mollit", "anim", "laborum",
)
_LOREM_SMALL = ("sit", "sed", "do", "ut", "et", "ad", "ex", "ea", "in", "id", "est", "non", "qui")


def _any(patterns: list[str]) -> str:
    return "|".join(f"(?:{p})" for p in patterns)


_LATIN = "(?:" + "|".join(LOREM_WORDS) + ")"
_RUN = r"\b" + _LATIN + r"(?:[\s,.]+(?:" + "|".join((*LOREM_WORDS, *_LOREM_SMALL)) + r")\b){3,8}"
_PLACEHOLDER = _any(PLACEHOLDERS)
_WHOLE = "^\\W{0,2}(?:" + _any(WHOLE) + r")\s*(?:[|·–—\-:]\s*[^|·–—]{1,60})?\W{0,3}$"
_KNOWN = sorted({*MESSAGE_WORDS, *LOREM_WORDS, *(w for ws in FUNCTION_WORDS.values() for w in ws), *"re ve ll don doesn isn couldn can ne qu".split()})
#: Syntax of programs that no prose has.
_SYNTAX = r"^\W{0,3}(?:(?:java|javax|org|com|system|kotlin)\.\w+\.|sqlstate\[|traceback \(|(?:php )?(?:fatal error|warning|notice|deprecated): .*(?: in /| on line \d))"
#: Where one part of a field ends and the next begins; a part may be led by a name and a colon.
_PARTS = r"(?<=[.!?…。！？])\s+|\s+[|·–—-]\s+"
_START = r"^(?:[^:\n]{1,40}:\s)?\W{0,3}(?:"


def _let(value: Column, body) -> Column:
    """body(value) with ``value`` worked out once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def readable(text: Column) -> Column:
    """Character entities of markup resolved, invisible characters dropped, white space collapsed, in lower case."""
    entities = (
        ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#039;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&#160;", " "),
        ("&#123;", "{"), ("&#125;", "}"), ("&#37;", "%"), ("&amp;", "&"),
    )

    def resolved(t: Column) -> Column:
        out = t
        for entity, char in entities:
            out = F.replace(out, F.lit(entity), F.lit(char))
        return F.when(F.instr(t, "&") > 0, out).otherwise(t)

    shown = _let(F.lower(F.regexp_replace(text, "[\\u200B-\\u200D\\u2060\\uFEFF\\u00AD]", "")), resolved)
    return F.trim(F.regexp_replace(shown, r"(?U)\s+", " "))


def _filled(part: Column) -> Column:
    """Whether a part that begins like a message holds (nearly) nothing else."""
    words = F.filter(F.split(F.regexp_replace(part, r"(?<!\S)/\S+", " "), r"[^\p{L}\p{N}_]+"), lambda w: F.char_length(w) > 1)
    strange = F.filter(words, lambda w: ~(w.isin(*_KNOWN) | w.rlike(r"\p{N}|(?:error|exception)$")))
    japanese = part.rlike(r"[\p{IsHiragana}\p{IsKatakana}\p{IsHan}]")
    return F.when(japanese, F.char_length(part) <= LONGEST_JAPANESE).otherwise(part.rlike(_SYNTAX) | (F.size(strange) <= STRANGE))


def _judge(prose: Column) -> Column:
    """Whether a field in lower case, made readable, is residue."""
    suspicious = prose.rlike(r"[{}<>\[\]%$_@]")
    rest = F.when(suspicious, F.regexp_replace(prose, _PLACEHOLDER, "")).otherwise(prose)

    def placeholder(r: Column) -> Column:
        cut = F.length(prose) - F.length(r)
        return (cut > 0) & ~((cut < 0.5 * F.length(prose)) & r.rlike(_TUTORIAL))

    def filler(words: Column) -> Column:
        some = F.size(F.array_intersect(words, F.array(*[F.lit(w) for w in LOREM_WORDS]))) >= 2
        latin = F.size(F.filter(words, lambda w: w.isin(*LOREM_WORDS)))
        small = F.size(F.filter(words, lambda w: w.isin(*_LOREM_SMALL)))
        most = (latin >= 4) & (latin + small >= 0.6 * F.size(words))
        return some & (most | ((latin >= 3) & (latin + small >= 0.9 * F.size(words))) | ((latin >= 4) & prose.rlike(_RUN)))

    def message(lines: Column) -> Column:
        """One pattern search over all parts; the few fields with an opener are looked at part by part."""
        some = F.lit(False)
        for i in range(0, len(OPENERS), 20):
            some = some | lines.rlike("(?m)" + _START + _any(OPENERS[i : i + 20]) + ")")
        return some & F.exists(F.split(lines, "\n"), lambda x: F.when(x.rlike(_START + _any(OPENERS) + ")"), _filled(x)).otherwise(F.lit(False)))

    lines = F.regexp_replace(prose, _PARTS, "\n")
    words = F.filter(F.split(prose, r"[^\p{L}]+"), lambda w: w != "")
    return (suspicious & _let(rest, placeholder)) | prose.rlike(_WHOLE) | _let(words, filler) | _let(lines, message)


def is_residue(text: Column) -> Column:
    """Whether the field shows a template, filler, error or script notice; false for null and blank."""
    code = lambda t: F.when(t.rlike("[`<]"), F.regexp_replace(t, r"(?s)`[^`]*`|<(code|pre)[^>]*>.*?</\1>", " ")).otherwise(t)
    return F.coalesce(_let(_let(readable(text), code), lambda p: (p != "") & _judge(p)), F.lit(False))


def residue_fields(pages: DataFrame) -> DataFrame:
    """(page_id, field): fields of pages that are residue, each once."""
    p = pages.select("id", "title", "meta_description").where(F.col("id").isNotNull())
    p = p.select("id", is_residue(F.col("title")).alias("t"), is_residue(F.col("meta_description")).alias("d")).where("t or d")
    fields = F.filter(F.array(F.when(F.col("t"), F.lit("title")), F.when(F.col("d"), F.lit("meta_description"))), lambda x: x.isNotNull())
    return p.select(F.col("id").alias("page_id"), F.explode(fields).alias("field")).distinct()


def real_texts(pages: DataFrame) -> DataFrame:
    """(page_id, title, meta_description) with residue set to null, pages that keep a non-blank text only."""
    keep = lambda c: F.when(~is_residue(F.col(c)) & F.col(c).rlike(r"(?U)\S"), F.col(c))
    p = pages.select("id", "title", "meta_description").where(F.col("id").isNotNull()).distinct()
    p = p.select(F.col("id").alias("page_id"), keep("title").alias("title"), keep("meta_description").alias("meta_description"))
    return p.where("title is not null or meta_description is not null")
