"""Residue held out: wordings, template families and languages written apart from the labelled lines, which none of them is."""

import os

import ahocorasick
import pyarrow as pa
import pyarrow.parquet as pq

from inkwell.llm import residue, residue_lines

RESIDUE = """
{$customer.city}
Hello %FIRSTNAME%
<!-- TODO insert summary here -->
410 Gone
Accès refusé.
服务器内部错误
Error 521: web server is down
Ship to: {{order.shipping_address.street}}
Best regards, [Your Full Name]
Hi [[first_name]], your parcel is on its way.
Written by {author_name} on {publish_date}.
The winner is <%= @winner.name %>!
[Insert short biography of the writer here]
[PLACEHOLDER: back cover text]
<Enter subtitle>
XXX: fill in the name of the translator
TODO write the introduction
Publisher: undefined
Price: NaN
Total: [object Object] items
Dear __RECIPIENT__,
See you on @@EVENT_DATE@@.
{% block content %}{% endblock %}
#NAME?
#DIV/0!
[Titel des Buches hier eintragen]
[Escriba aquí el nombre del capítulo]
[Saisir ici le nom de l’éditeur]
[Inserire qui il titolo]
[Wstaw tutaj tytuł]
【请在此输入标题】
在此处输入内容
【ここに説明文を入力してください】
[यहाँ नाम लिखें]
Duis aute irure dolor in reprehenderit in voluptate velit esse cillum dolore eu fugiat nulla pariatur.
Excepteur sint occaecat cupidatat non proident, sunt in culpa qui officia deserunt mollit anim id est laborum.
Nemo enim ipsam voluptatem quia voluptas sit aspernatur aut odit aut fugit.
Nullam quis risus eget urna mollis ornare vel eu leo.
Dummy text for layout purposes only.
This is sample content. Replace it with your own text.
Dies ist nur ein Platzhaltertext.
Texto de ejemplo, por favor reemplácelo.
Ceci est un faux texte qui sera remplacé.
这是一段占位文本
この文章はダミーです。
यह केवल नमूना सामग्री है।
blah blah blah blah
Oops! That page can’t be found.
Whoops, something went wrong on our end.
The server encountered a temporary error and could not complete your request.
The website cannot display the page right now.
This content is no longer available at this address.
HTTP Error 503. The service is unavailable.
upstream connect error or disconnect/reset before headers
Fatal error: Uncaught exception in index.php on line 27
java.lang.NullPointerException
You are not authorized to access this resource.
Your login session timed out, please log in again.
You have been rate limited, try again in a few minutes.
Verify that you are human before continuing.
JavaScript is disabled in your browser.
This application needs JavaScript to run correctly.
Your browser does not support scripts.
Die angeforderte Seite existiert leider nicht.
Für diese Seite wird JavaScript benötigt.
Ein interner Serverfehler ist aufgetreten.
La página solicitada no existe.
Active JavaScript para continuar.
Se ha producido un error interno del servidor.
La page demandée n’existe pas.
JavaScript est désactivé dans votre navigateur.
Une erreur interne du serveur est survenue.
Pagina non trovata, errore 404
Nie znaleziono strony.
Włącz JavaScript w przeglądarce.
Страница не найдена
Пожалуйста, включите JavaScript в браузере.
您请求的页面无法找到
本网站需要启用JavaScript才能正常运行
お探しのページは見つかりませんでした。
このサイトを利用するにはJavaScriptが必要です。
सर्वर में आंतरिक त्रुटि हुई।
यह पृष्ठ उपलब्ध नहीं है।
Hey *|FNAME|*, thanks for joining {{ company }}
[Place author photo here]
$$PLACEHOLDER$$
Lorem ipsum text will be replaced by the publisher.
Suspendisse potenti in faucibus orci luctus.
Error 1020: Access denied
No route matches this address.
There has been a critical error on this website.
504 Gateway Time-out
Bad Request (invalid hostname)
Turn on JavaScript to see the rest.
Sie haben keine Berechtigung, diese Seite zu öffnen.
Este contenido no está disponible.
无法访问此网站
アクセス権限がありません
"""

PROSE = """
He wrote his title on the card and left the author's name blank.
The author of the letter was not found until the spring.
She tore the page out, and it could not be found again.
The server brought two plates and an apology for the error.
The old template hung on the joiner's wall beside the saw.
“You are not permitted to enter,” the porter told her, and he let the bar fall.
“Please try the other gate,” he said, “this one has been stuck since Easter.”
Your name, he said, is not in the book; come back on Thursday.
It was a bad gateway to the town, narrow and always wet.
The forbidden fruit lay on the table, and nobody moved.
The request was denied by the council after an hour of shouting.
They were too many, and their requests too dear.
“Not found!” cried the boy, and threw the empty box on the floor.
An internal error of the clock, the watchmaker said, and charged her twice.
The session had expired before the judge came back from dinner.
He could not read the script, for the ink had run.
The scripts of both plays were kept in a tin trunk under the bed.
The service was held at nine, and then again at noon for the sailors.
The cookie jar stood on the browser's shelf in the reading room.
Replace the lid, stir twice, and let the broth stand until evening.
Sample the soup before you salt it, my mother used to say.
The text here is hard to make out, and the scribe seems to have been asleep.
[Illustration: The keeper at his window]
[Footnote 3: In the second edition this line is missing.]
[Sidenote: Of the building of the bridge]
[Editor's note: two leaves are wanting here.]
[exit the King]
{a note in pencil: see the other book}
The marks <s> and </s> he left to the printer, who ignored them.
It cost %10 more, or so the bill seemed to say.
The price was $12, or $15 with the frame.
Let the set be {1, 2, 3} and its complement the rest.
In room 404 the lamp was lit, and someone coughed.
He served 500 people on the first day and 503 on the second.
Lorem was her favourite word in the whole of the printer's book.
Dolor, the old priest explained, means pain, and sit amet means nothing at all.
Die Seite fehlte, und niemand wusste, wer sie genommen hatte.
Der Fehler lag nicht beim Diener, sondern beim Wirt.
Er bat um Zugang zum Garten, doch das Tor blieb zu.
La page était blanche comme la neige du matin.
L’erreur du capitaine coûta trois bateaux à la ville.
Le titre du livre lui plaisait plus que le livre.
La página del diario estaba rota por la mitad.
El error del maestro fue confiar en la lluvia.
El servidor dejó la bandeja y salió sin decir palabra.
他翻到那一页，却找不到那个名字。
这个错误让老人笑了很久。
标题写得很大，作者的名字却很小。
彼はそのページを何度も読み返した。
間違いは誰にでもある、と先生は言った。
उसने पन्ना पलटा और नाम ढूँढ़ता रहा।
गलती उसकी नहीं थी, फिर भी वह चुप रहा।
The quick brown fox jumped over the fence and was gone.
To do: nothing, she wrote, and slept until ten.
N. A. Null was a chemist of Leipzig.
Once upon a time there was a miller who had three sons.
Chapter 12. In which the storm arrives.
Printed for the author by T. Brown, 1842.
The heading was painted in red above the door of the chapel.
Here is the place where the text of the will breaks off.
He would not replace the paragraph, whatever the publisher said.
The connection between the two families was never closed.
Too many cooks had asked for the same kitchen.
He was denied permission to see his own daughter.
The gateway was closed, and the time had run out.
Der Text steht auf der letzten Seite des Buches.
Le nom du roi manque sur la pierre.
El nombre del barco no está en la lista.
她在纸上写下自己的名字，然后把门关上。
彼女は手紙に名前を書かなかった。
"""


def _lines(text):
    return [line for line in text.strip().splitlines() if line]


def test_held_out_lines_are_found_and_prose_is_not():
    bad, good = _lines(RESIDUE), _lines(PROSE)
    ratios = residue._ratios(_corpus())
    owners = set(residue.score(pa.array(bad + good), ratios)[0].tolist())
    missed = [line for i, line in enumerate(bad) if i not in owners]
    false = [line for i, line in enumerate(good) if i + len(bad) in owners]
    assert len(missed) <= 0.1 * len(bad), missed
    assert len(false) <= 0.02 * len(good), false


def test_held_out_lines_within_documents():
    """The same lines amid real content, where only the part is residue."""
    bad = _lines(RESIDUE)
    ratios = residue._ratios(_corpus())
    texts = ["The mill stood by the river.\n\n%s\n\nNobody came for a week, and the wheel turned alone." % line for line in bad]
    owners = set(residue.score(pa.array(texts), ratios)[0].tolist())
    assert len(owners) >= 0.9 * len(bad)


def test_no_labelled_line_stands_in_the_documents_or_the_held_out_lines():
    texts = [t for sf in ("sf0.01", "sf0.1") if os.path.exists(path := f"/root/testdata/{sf}/documents.parquet") for t in pq.read_table(path, columns=["text"]).column("text").to_pylist() if t]
    found = ahocorasick.Automaton()
    labelled = residue_lines.labelled()
    for kind in labelled.values():
        for line in kind:
            found.add_word(line.casefold(), line)
    found.make_automaton()
    held_out = {line.casefold() for line in _lines(RESIDUE) + _lines(PROSE)}
    assert not [line for kind in labelled.values() for line in kind if line.casefold() in held_out]
    seen = {line for text in texts for _, line in found.iter(text.casefold())}
    assert not seen, sorted(seen)


def _corpus():
    """Counts of a real corpus: all documents of the small tables."""
    import numpy as np

    column = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"]).column("text").combine_chunks()
    prior = residue._ratios(np.zeros(residue.SIZE))
    hashed, segments, _ = residue.grams(column)
    return residue.natural_counts(hashed, segments, prior)
