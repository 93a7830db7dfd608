from pyspark.sql import functions as F

from sitelens.llm.residue import is_residue, real_texts, residue_fields

CASES = [
    "{{ page.title }} | Shop", "Buy {product} in {city}", "{% block title %}{% endblock %}", "%%title%% %%sep%% Shop", "<%= @page_title %>", "&lt;?php echo $title; ?&gt;", "[[*pagetitle]] - Shop",
    "${product.name} – Shop", "#{category.name} 41 products", "%s - %s", "The tent pole, tested – %sitename%", "Tent pole XY-1 | [store_name]", "__PAGE_TITLE__", "$PAGE_TITLE$", "@Model.Title", "TITLE_TAG_4", "<title>",
    "[headline] [subline]", "{# description #} A woven bag for campers", "Lorem ipsum dolor sit amet", "Made in 2005, this pot needs cillum mollit nisi dolor ut elit.", "Untitled document", "Copy of Copy of Untitled 3", "XXXXX xxxx xxx",
    "asdf asdf asdf", "test test 3", "(no title)", "Loading…", "Your page title goes here", "Insert a short summary of this page here.", "Describe your page in one or two sentences.", "Titre de la page à compléter", "Blindtext Überschrift 2",
    "Dies ist ein Blindtext, der später ersetzt wird.", "Texto de relleno 4, sustituir antes de publicar.", "404 Not Found", "HTTP Status 1020 – Not Found", "Seite nicht gefunden – Shop", "Страница не найдена", "ページが見つかりません", "Página no encontrada",
    "Page introuvable | Shop", "Error 404 (Not Found) · Shop", "Error establishing a database connection", "Fatal error: Uncaught TypeError in /srv/www/1.php", "SQLSTATE[HY000] [2002] Connection refused", "Access denied", "503 Service Temporarily Unavailable",
    "Traceback (most recent call last): KeyError 4f", "undefined | Shop", "NaN results for undefined", "[object Object]", "null", "Just a moment...", "Please enable JavaScript to view this page.", "Bitte aktivieren Sie JavaScript in Ihrem Browser.",
    "Activez JavaScript pour continuer", "Активируйте JavaScript в браузере.", "Checking if the connection is secure. Enable cookies and reload.", "Session expired – please log in again", "This domain is parked", "  PLEASE ENABLE JAVASCRIPT ", "Whoops, something went wrong", "Oops! That page can’t be found.", "Shop: Access denied",
]
REAL = [
    None, "", "   ", "Curly braces { } in CSS explained by Mezedran", "Lorem, ipsum and type specimens: print shop", "JavaScript course for retirees in Bath, July 2021", "Room 404: a kettle at the museum", "Null Island maps and other prints",
    "Error codes of the wheel pump TN-859 and what they mean", "Template for a dog bed plan (ash)", "Save 50% on heated %RH meters from Grogiobrin", "How Ann designs a 404 page for kettle fans", "Sample boxes of linen from Kubruplin",
    "Page 18 of the manual for beginners lists not found and out of stock notices.", "Runs without JavaScript; error 46 in Bath means the linen bag is open.", "Lesson 12: JavaScript for a bath mat shop, taught by Ann.", "A handlebars guide: `{{ name }}` and other variables in templates",
    "Ann keeps 13 error messages and their copper sample cards.", "The Brisioran menu loads with JavaScript off, says Bath; code 15 is fine.", "Thé et café, 100 % bio", "word " * 5000, "Ein Test in fünf Größen", "Untitled no more: naming your paintings in nine steps",
]

# Real texts about errors, scripts, templates and filler, in eight languages.
ABOUT = [
    "Page not found errors: how to find and fix them on large shops", "Something went wrong at the summit: a climber's memoir", "Fatal error: a novel by Jane Roe", "An error occurred in 1912: history of a shipwreck",
    "JavaScript is required reading in this year's web development course", "Lorem ipsum: history of the printer's dummy text", "Access denied: twelve castles closed to visitors since 1950", "Session expired parking tickets and how to contest them",
    "Just a moment of silence, a play in three acts by Ann Lee", "Please wait for the whistle: station stories from Bath", "404 not found: an exhibition of lost paintings", "Warning: undefined behaviour in C explained with examples",
    "The page you requested does not exist, and other polite refusals in library letters", "Under construction: bridges of the Rhine valley", "Coming soon to the museum: copper kettles of the north", "Enable JavaScript debugging in your editor with six shortcuts",
    "Your browser does not matter: choosing fonts for slow readers", "Verify you are human, a philosophical essay on trust", "Checking your browser history for travel ideas", "Too many requests for jam: how the bakery copes in August",
    "Service unavailable on Sundays, says the ferry museum's old timetable", "Hello world: greetings from forty countries on enamel plates", "Enter your description of the bird in the notebook and draw its beak", "Syntax error: poems by a retired compiler engineer",
    "Internal server error handling with retries for busy kitchens", "This domain is parked cars and petrol stations: photographs", "Error 404 magazine, issue twelve, with essays on missing maps",
    "Seite nicht gefunden: Wie Bibliothekare verlorene Blätter suchen", "Fehler 404 verstehen und im eigenen Shop beheben", "JavaScript ist deaktiviert: Barrierefreie Seiten ohne Skripte gestalten", "Bitte warten im Museum: Geschichte der Warteräume in Wien", "Blindtext als Kunstform, eine Ausstellung in Graz",
    "Dies ist ein Blindtext: Wie Setzer Probeseiten füllten", "Zugriff verweigert: ein Kriminalroman aus Bremen", "So verwenden Sie {{ name }} in einer Vorlage für Rechnungen", "Interner Serverfehler als Kurzgeschichte von Petra Maus",
    "Page introuvable : enquête sur les manuscrits perdus de Lyon", "Erreur 404 expliquée aux libraires et aux lecteurs", "Activer JavaScript pas à pas dans un ancien navigateur de musée", "Accès refusé : les jardins secrets de Paris",
    "Utiliser {{ nom }} dans un gabarit de lettre, le guide complet", "Texte de remplissage et typographie : petite histoire du plomb", "Un instant de calme au bord du lac, récit de voyage", "Nous n’avons pas pu trouver le trésor : journal d’un plongeur",
    "Página no encontrada: relatos de archivos perdidos en Sevilla", "Acceso denegado: la muralla y sus puertas cerradas", "Cómo usar {{ nombre }} en una plantilla de correo", "Texto de relleno en la imprenta antigua de Toledo", "Un momento en la cocina de la abuela, recetas de otoño", "No se ha encontrado vida en Marte, dice el observatorio",
    "Página não encontrada: crónicas de um bibliotecário de Lisboa", "Acesso negado: romance policial em três partes", "Ative o forno e prepare o pão em quarenta minutos", "Usar {{ nome }} num modelo de fatura, lição dois",
    "Nie znaleziono strony tytułowej: zagadka starego atlasu", "Brak dostępu do morza, opowieść o kraju w górach", "Włącz obsługę pieca krok po kroku, poradnik dla piekarzy", "Jak użyć {{ imie }} w szablonie listu",
    "Страница не найдена: рассказы о пропавших рукописях", "Доступ запрещён: прогулки по закрытым садам Москвы", "Ошибка сервера в ресторане и другие весёлые истории", "Как вставить {{ имя }} в шаблон письма",
    "JavaScriptが必要な理由を学ぶ初心者向け講座", "ページが見つかりませんと言われた作家の回想録を読む会のご案内と日程", "エラーが発生しましたという題名の短編小説集とその作者について", "テンプレートで {{ 名前 }} を使う方法",
]


def test_texts_about_such_things_are_real(spark):
    assert len(ABOUT) >= 60
    df = spark.createDataFrame([(t,) for t in ABOUT], "t string")
    assert [r["t"] for r in df.where(is_residue(F.col("t"))).collect()] == []


def test_cases_and_real_texts(spark):
    df = spark.createDataFrame([(t,) for t in CASES + REAL], "t string")
    got = [r[0] for r in df.select(is_residue(F.col("t"))).collect()]
    assert [t for t, g in zip(CASES, got) if not g] == []
    assert [t for t, g in zip(REAL, got[len(CASES):]) if g] == []


def test_fields_of_pages(spark):
    rows = [("1", "404 Not Found", "{{ x }}", "a"), ("1", "404 Not Found", "{{ x }}", "a"), ("2", "Real", None, "b"), ("3", None, None, "c"), (None, "null", "null", "d")]
    df = spark.createDataFrame(rows, "id string, title string, meta_description string, field string")
    assert sorted(map(tuple, residue_fields(df).collect())) == [("1", "meta_description"), ("1", "title")]
    assert [tuple(r) for r in real_texts(df).collect()] == [("2", "Real", None)]
    assert residue_fields(df.limit(0)).count() == 0


def test_very_long_fields(spark):
    long = ["lorem ipsum dolor amet " * 20000, "xxx " * 30000 + "y", "x" * 50000 + "y", "asdf" * 20000 + "!y", "com." + "a." * 40000, "null " * 30000 + "end", "a b " * 40000, "{{" * 30000, "<code>" * 5000, "Error " * 30000, "Kettle. " * 30000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(long)], "i int, t string")
    got = {r["i"]: r["r"] for r in df.select("i", is_residue(F.col("t")).alias("r")).collect()}
    assert got[0] and not got[2] and not got[6] and not got[10]


def test_length_is_no_limit(spark):
    yes = ["test " * 5000, "null " * 5000, "undefined " * 5000, "xxx " * 5000, "asdf " * 5000, "aaa bbb " * 5000, "xxx ---- xxx", "null ..... null", "[object Object] " * 400 + "| Shop", "xxx | Brand name", "aaa bbb ccc | brand name"]
    yes += ["Access denied. " + "kettle " * 5000, "Please enable JavaScript to continue | " + "kettle " * 5000]
    yes += ["{{ " + "a " * 500 + "}} | Shop", "{% if " + "a " * 500 + "%}", "<% " + "a " * 500 + "%>", "<?php " + "a " * 500 + "?>", "[[ " + "a " * 500 + "]]", "${ " + "a " * 500 + "}"]
    no = ["test " * 5000 + "of a kettle", "null " * 5000 + "and a kettle", "<% " * 20000, "[[" * 20000, "{% a" * 20000, "aaa bbb"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(yes + no)], "i int, t string")
    got = {r["i"]: r["r"] for r in df.select("i", is_residue(F.col("t")).alias("r")).collect()}
    assert [i for i in range(len(yes)) if not got[i]] == [] and [i for i in range(len(yes), len(got)) if got[i]] == []
