import time

import pytest

from brindle.llm.residue import find_residue, residue, without_residue

ARTICLE = r"""\documentclass{article}
\usepackage{lipsum}
\newcommand{\foo}[1]{{\bf #1}^{\ast}}
\title{On the weak field of shallow signals}
\author{A. Name \and B. Other}
\begin{document}
\maketitle
\begin{abstract}
We show that ${{\cal A}}_{n} \to \frac{a}{b + 2}$ holds for every compact mode.
\end{abstract}

\section{Model}\label{sec:1}
%s

\begin{thebibliography}{99}
\bibitem{a} A. Name. \emph{404 Not Found}. Journal 3, 404 (1999).
\end{thebibliography}
\end{document}"""

WHOLE = [
    "You need to enable JavaScript to run this app.", "<html>\n<head><title>502 Bad Gateway</title></head>\n<body></body>\n</html>", "Not Found\n\nThe requested file x.tar.gz was not found on this server.",
    '{"status": 503, "error": "Service Unavailable"}', "NOT FOUND", "[Menu] [Search]\n\nErreur 404 : la page demandée est introuvable.", "Lorem ipsum dolor sit amet, consectetur adipiscing elit.",
    "Bitte aktivieren Sie JavaScript in Ihrem Browser.", 'Traceback (most recent call last):\r\n  File "x.py", line 1\r\nValueError: y', "Type your text here.", "{{ page.body }}",
]

PASSAGES = [
    r"\lipsum[2-4]", r"\blindtext", "\\begin{figure}\n\\caption{Insert caption here.}\n\\end{figure}", "Lorem ipsum dolor sit amet labore nostrud.", "Excepteur tempor labore aute veniam esse officia velit.", "[TODO: describe the data set]", "[Insert discussion here]", "<Your text goes here>",
    "*** fill in results ***", "Write this section.", "XXX PLACEHOLDER PARAGRAPH XXX", "xxxxxxxxxxxxxxxxxxxxxxx\nxxxxxxxxxxxxxxxxx", "undefined\n\nNaN", "{{ section.text }}", "<%= body %>", "${results}", "@@BODY@@", "<#include 'model.tex'>",
    "In this paper we present {contribution} for {problem}.", "Skip to main content\nYour session has expired. Log in again to download it.", "This page requires JavaScript.", "Texte à insérer ici.", "Dies ist ein Blindtext.", "503 Service Unavailable: upstream returned no data",
]

CONTENT = [
    "Each page asked the reader to enable JavaScript before the panel was drawn.", "An internal server error (status 500) at hour 7 interrupted the run; the samples were measured again.",
    r"Designers fill columns with passages such as \emph{lorem ipsum dolor sit amet} when no copy exists.", "The title of this section quotes the notice ``Access denied'' that users reported 31 times.",
    r"Of the 640 links, 6 per cent returned \texttt{404 Not Found} and a further share timed out.", "% Insert your abstract here.\n% [TODO: fill in]\nThe signal is weak.", "\\iffalse\n[Insert discussion here]\nLorem ipsum dolor sit amet.\n\\fi\nThe signal is weak.",
    "\\begin{lstlisting}\n<h1>{{ page.title }}</h1>\n\\end{lstlisting}\nThe listing shows the syntax; slots such as \\verb|{{ name }}| are reported.", "\\begin{verbatim}\nexport DATA=${HOME}/runs\nsed s/@@SEED@@/17/ x\n\\end{verbatim}",
    r"In the automaton \texttt{XXX} stands for any letter, and \texttt{[X]} for any class.", r"We write ${{\cal A}}_{n}$ and $\{\{x, y\}\}$ for multisets; the index is \#1.", "[INST] is the name of the institute. </s>", "<|endoftext|>", "A placeholder symbol is used where a value is missing in the sample.",
    "\\begin{comment}\n[your text here]\n\\end{comment}\nA real note.", "The sample {na} was measured once.", "Not found in earlier work, the effect is small.", "The requested precision was not reached.", "An error occurred in the second run and was corrected.", "The system is closed for all finite times.",
]


@pytest.mark.parametrize("text", WHOLE)
def test_whole_records(text):
    assert residue(text) and residue(text.upper() if "{" not in text else text)


@pytest.mark.parametrize("passage", PASSAGES)
def test_passages_of_articles(passage):
    assert residue(ARTICLE.replace("%s", passage))
    assert residue(ARTICLE.replace("%s", f"The signal is weak.\n\n{passage}\n\nThe field is strong.").replace("\n", "\r\n"))


@pytest.mark.parametrize("passage", CONTENT)
def test_content_that_mentions_residue(passage):
    assert residue(ARTICLE.replace("%s", passage)) is None


@pytest.mark.parametrize("title", ["Paper Title", "{{ paper.title }}", "${title}", "[[title]]", "__TITLE__", "{0}", "undefined", "<TITLE OF PAPER>", "Untitled", "$$TITLE$$", "[object Object]"])
def test_titles(title):
    assert residue(ARTICLE.replace("On the weak field of shallow signals", title).replace("%s", "Fine."))


@pytest.mark.parametrize("author", [r"First Author \and Second Author", "$AUTHOR_LIST$", "@@AUTHORS@@", "{author_1}, {author_2}", "Author Name"])
def test_authors(author):
    assert residue(ARTICLE.replace(r"A. Name \and B. Other", author).replace("%s", "Fine."))


def test_no_cases(spark):
    for text in (None, "", "  \n", "\xa0", r"$\frac{a}{b}$", "A short note.", ARTICLE.replace("%s", "Fine."), ARTICLE.replace("%s", "Fine.")[:150], r"\input{missing/part}", "x" * 5):
        assert residue(text) is None
    rows = [(1, WHOLE[0], "a"), (2, None, "b"), (3, "", "c"), (4, "A real note.", "d"), (1, WHOLE[0], "e"), (None, PASSAGES[0], "f")]
    df = spark.createDataFrame(rows, "doc_id long, text string, kind string")
    assert sorted((str(r.doc_id), r.kind) for r in find_residue(df).collect()) == [("1", "notice"), ("1", "notice"), ("None", "filler")]
    assert sorted(r.kind for r in without_residue(df).collect()) == ["b", "c", "d"]
    assert find_residue(df.limit(0)).collect() == []


def test_residue_behind_a_very_long_text():
    assert residue(ARTICLE.replace("%s", "The signal is weak. " * 50_000 + "\n\n\\lipsum")) == "filler"
    assert residue(ARTICLE.replace("%s", "{" * 20_000 + "The signal is weak. " * 1000)) is None


@pytest.mark.parametrize("part", ["\\title{", "{{", "[insert ", "<", "\\verb|", "\\begin{comment}", "lorem ", "${a", "Home | ", "@A", "%", "x "])
def test_repeated_openings_take_no_long_time(part):
    began = time.perf_counter()
    residue(part * 20_000)
    assert time.perf_counter() - began < 5


@pytest.mark.parametrize(
    "passage",
    [
        r"\paragraph{Data.} Lorem ipsum dolor sit amet, consectetur adipiscing elit.", r"\section{Model} \lipsum[2]", r"\section{Model} [Insert text here]", r"\section{{{ section.title }}}", r"\subsection*[Short]{A $x_{1}$} [Insert text here]",
        r"\chapter*{One} Write this section.", r"\section{Insert section title here\label{sec:2}}", r"\section{One} The signal is weak. \section{Two} The field is strong. \section{Three} Lorem ipsum dolor sit amet. \section{Four} It ends.",
        r"\begin{abstract}[Insert abstract here]\end{abstract}", r"\begin{abstract}{{ abstract }}\end{abstract}", r"\begin{quote}[Insert text here]" + "\nThe signal is weak.\n" + r"\end{quote}", r"\begin{theorem}[{{ theorem.name }}]" + "\nThe field is strong.\n" + r"\end{theorem}",
    ],
)
def test_residue_beside_commands(passage):
    assert residue(ARTICLE.replace("%s", passage)) and residue(passage)


@pytest.mark.parametrize(
    "passage",
    [
        r"\section{Access denied} The notice was seen 31 times.", r"\section{{model}} Fine.", r"\paragraph{Added in proof.} A note of the author.", r"\section{A {\bf b} $c_{n}$} \label{x} Fine.", "\\begin{theorem}[Type]\nFine.\n\\end{theorem}",
        "\\begin{tabular}{l@{ }c}\n1 & 2\n\\end{tabular}", "\\begin{axis}[xlabel = {time}, ylabel = {length}]\n1\n\\end{axis}", "\\newtheorem{satz}{Satz}\n\n\\begin{satz}[Type]\nFine.\n\\end{satz}", r"\section{Open brace", "\\begin{figure}[here]\nFine.\n\\end{figure}",
    ],
)
def test_commands_beside_content(passage):
    assert residue(ARTICLE.replace("%s", passage)) is None


FRAMES = "Traceback (most recent call last):\n" + '  File "/srv/render/article.py", line 31, in render\n    return self.parts[name].render(context)\n' * 60 + "ValueError: y"
META = '<meta charset="utf-8">\n<link rel="stylesheet" href="/a.css">\n'
LONG = [
    "Dies ist ein Blindtext. Er dient nur dazu, den Platz der Zusammenfassung zu fuellen. " * 30, "Insert your abstract here. " * 200, "Insert your abstract here " * 3, "Insert your abstract here " * 30, FRAMES, FRAMES.partition("\n")[2],
    "<html>\n<head>\n" + META * 4 + "<title>502 Bad Gateway</title>\n</head>\n<body>\n" + "<p>The upstream server gave no answer that could be read.</p>\n" * 90 + "</body>\n</html>",
    META * 4 + "<noscript>You need to enable JavaScript to run this app.</noscript>", "Journals\nSubmit a paper\nArchive\nFor authors\nNews\nNot Found\nThe file x was not found on this server.",
    "<html>\n<style>\n" + "p { color: red; margin: 2em; } /* a rule of the page that is not shown to the reader */\n" * 60 + "</style>\n<body>\nYour session has expired. Log in again.\n</body>",
    "We thank all readers of this page.\nThe journal began in 1999.\nIt has four issues a year.\nAll of them are free to read.\n" + "An error occurred while processing the article; it can't be shown to you at this time.\n" * 80,
]


@pytest.mark.parametrize("text", LONG)
def test_length_does_not_matter(text):
    assert residue(text) and residue(ARTICLE.replace("%s", text))


def test_a_message_in_a_long_paragraph():
    told = "The runs of the second week were repeated, and the samples of both weeks agree with each other.\n"
    message = "An error occurred while processing the article; it can't be shown to you at this time.\n"
    for n in (5, 50, 500):
        assert residue(told * n + message + told * n) is None and residue(told * n + "Insert your abstract here. " + told * n) is None
        assert residue(told * n + message * 2 * n) == "error"


@pytest.mark.parametrize("part", ["\\section{", "\\begin{x}{", "\\begin{theorem}[", "\\paragraph[", "\\section{a}"])
def test_repeated_commands_take_no_long_time(part):
    began = time.perf_counter()
    residue(part * 20_000)
    assert time.perf_counter() - began < 5


@pytest.mark.parametrize("part", ["Insert your abstract here ", "Insert your abstract here. ", "<style>", "<!--\n", "<script>\n", "Home\n", "The field. ", "at a(", "a\nWhat is told by this line is not an error\n"])
def test_long_passages_take_no_long_time(part):
    began = time.perf_counter()
    residue(part * 20_000)
    assert time.perf_counter() - began < 5


@pytest.mark.parametrize("last", [r"Second Author", "{author_90}"])
def test_long_lists_of_authors(last):
    names = "A. Name\n" + "\\and B. Other \\thanks{The {\\it same} place \\}.}\n" * 400
    for place in (names + last, names + last + "\n" + names):
        assert residue(ARTICLE.replace(r"A. Name \and B. Other", place).replace("%s", "Fine.")) == "placeholder"
        assert residue("\\begin{document}\n\\author{" + place + "}\n\\maketitle\nFine.\n\\end{document}") == "placeholder"
    assert residue(ARTICLE.replace(r"A. Name \and B. Other", names).replace("%s", "Fine.")) is None
    assert residue("\\begin{document}\n\\author{A. Name\n\\maketitle\n\\section{One}\nThe first author {na} wrote it.}\n") is None


@pytest.mark.parametrize("text", ["\\title{" * 20_000 + "\\maketitle" + "}" * 20_000, "\\title{\n" * 20_000 + "\\maketitle" + "}" * 20_000, "\\author{\\section" * 20_000 + "}" * 20_000])
def test_nested_arguments_take_no_long_time(text):
    began = time.perf_counter()
    residue(text)
    assert time.perf_counter() - began < 5


@pytest.mark.parametrize(
    "part",
    [
        r"\abstract{[Insert abstract here]}", "\\begin{abstract}Lorem ipsum dolor sit amet, consectetur adipiscing.\\end{abstract}", "\\begin{abstract}[Insert abstract here]\\end{abstract}", r"\affiliation{Institution Name}", r"\affil[1]{{{ affiliation }}}",
        r"\keywords{Insert keywords here}", "\\begin{keywords}\n{{ keywords }}\n\\end{keywords}", "\\abstract{The signal is weak.\n\n\\noindent [Insert text here]\n\nThe field is strong.}", "\\begin{abstract}\nThe signal is weak.\n\n\\lipsum[1]\n",
    ],
)
def test_residue_in_the_head(part):
    assert residue(ARTICLE.replace("\\begin{document}", part + "\n\\begin{document}").replace("%s", "Fine."))
    assert residue("\\begin{document}\n" + part + "\n\\maketitle\nFine.\n\\end{document}")


@pytest.mark.parametrize(
    "part",
    [
        r"\abstract{The signal is weak.}", "\\begin{abstract}\nThe signal is weak.\n\\end{abstract}", r"\affiliation[a]{organization = {Institute of Fields}, city = {dale}, country={nowhere}}", r"\keywords{signals, placeholder symbols, fields}",
        r"\newcommand{\affiliation}[1]{{\it #1}}", r"\renewcommand{\abstractname}{Text}", r"\def\abstract#1{{\bf #1}}", r"\newcommand{\todo}[1]{[insert: #1 here]}", r"\newenvironment{note}{\begin{abstract}}{\end{abstract}}",
    ],
)
def test_content_in_the_head(part):
    assert residue(ARTICLE.replace("\\begin{document}", part + "\n\\begin{document}").replace("%s", "Fine.")) is None


@pytest.mark.parametrize("part", ["\\abstract{", "\\begin{abstract}", "\\affil[", "\\keywords{a}", "\\affiliation{x = "])
def test_repeated_heads_take_no_long_time(part):
    began = time.perf_counter()
    residue(part * 20_000 + "\\begin{document}" + part * 20_000 + "}" * 20_000)
    assert time.perf_counter() - began < 5


@pytest.mark.parametrize(
    "passage",
    [
        "In Jinja, a variable is written {{ name }} and is replaced when the page is made.", "Python formats {name} and {value} inside strings.", "The syntax of a loop is {% for x in xs %} and of its end {% endfor %} in this language.",
        "Sorry, the proof of Lemma 2 in the first version was incomplete.", "Unable to render triangles in hyperbolic space, early software used discs.", '{"status": "ok"} is an example of a reply.', "An error occurred, in our view, in the proof of the lemma.",
        "The reply ``{{ name }}'' was seen once in the whole corpus of the archive.", "Could not find a difference between both groups, as the sample was small.", "Something went wrong in the second run, which was repeated.", r"The slot \texttt{{{ name }}} is kept.", '{"status": "ok", "rows": 3}',
    ],
)
def test_prose_about_residue(passage):
    assert residue(ARTICLE.replace("%s", passage)) is None


@pytest.mark.parametrize(
    "passage",
    [
        "blah text Text bla foo bar asdf text bla Text foo bar", "foo bar baz foo bar", "asdf asdf", "qwerty", "Sorry, we could not find that page.", "Unable to load the requested document.", "Failed to load resource", '{"error": "not found"}', '{\n  "status": 503,\n  "detail": "overloaded"\n}',
        "Pagina non trovata", "Página não encontrada", "Страница не найдена", "页面不存在", "ページが見つかりません", "Nie znaleziono strony", "Pagina niet gevonden", "Per leggere l'articolo è necessario abilitare JavaScript.", "Ative o JavaScript para ler o artigo.",
        "Включите JavaScript в браузере.", "请启用JavaScript", "このページを表示するにはJavaScriptを有効にしてください", "Zet JavaScript aan om dit te lezen.", "Włącz JavaScript, aby czytać artykuł.", "kufiko-1: This item is no longer hosted here.",
        "Inserire qui il testo", "Insira aqui o resumo", "Wpisz tutaj tekst", "Введите текст", "请输入正文", "ここに本文を入力してください", "Samenvatting volgt",
    ],
)
def test_more_residue(passage):
    assert residue(ARTICLE.replace("%s", passage)) and residue(passage)


@pytest.mark.parametrize("author", [r"Jane Roe\thanks{Univ. A; corresponding author}", "A. Lee, B. Wu (first author)", r"Jane Roe, Corresponding Author", r"A. Lee \\ Institute of Fields \and B. Wu", r"First author: A. Lee", r"A. Lee\inst{1} \and B. Wu\inst{2}"])
def test_authors_with_roles(author):
    assert residue(ARTICLE.replace(r"A. Name \and B. Other", author).replace("%s", "Fine.")) is None


@pytest.mark.parametrize("author", [r"First Author, Institution Name", r"First Author$^{1}$ \and Second Author$^{2}$", r"\textbf{Author One}\\University Name", r"Corresponding Author", r"Firstname Lastname", r"A. Lee \and {author_2}", r"Author 1 and Author 2", r"Erster Autor \and Zweiter Autor"])
def test_stock_authors(author):
    assert residue(ARTICLE.replace(r"A. Name \and B. Other", author).replace("%s", "Fine.")) == "placeholder"


@pytest.mark.parametrize("opening", ["```\nexport A={{ a }}\n", "\\iffalse\n{{ a }}\n", "\\begin{verbatim}\n{{ a }}\n", "\\begin{comment}\n[Insert text here]\n"])
def test_open_blocks_end_with_their_paragraph(opening):
    assert residue(ARTICLE.replace("%s", opening + "\nThe field is strong.\n\nIt ends.")) is None
    assert residue(ARTICLE.replace("%s", opening + "\n\n404 Not Found")) == "error"
    assert residue("404 Not Found\n\n" + opening) == "error"


def test_text_behind_the_end_of_a_document():
    assert residue(ARTICLE.replace("%s", "Fine.") + "\n[Insert text here]") is None
    assert residue("The command \\end{document} is missing.\n\n[Insert text here]") == "placeholder"


def test_phrases_miss_nothing(monkeypatch):
    """The verdicts are the same where every passage is read by all rules."""
    texts = [*WHOLE, *PASSAGES, *CONTENT, *LONG]
    found = [residue(ARTICLE.replace("%s", text)) for text in texts]
    monkeypatch.setattr("brindle.llm.residue._mentioned", lambda passage: 7)
    assert [residue(ARTICLE.replace("%s", text)) for text in texts] == found
