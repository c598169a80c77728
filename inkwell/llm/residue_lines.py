"""Labelled lines the residue models are fitted on: wordings with alternatives, spelled out to a bounded sample.

``(a|b|c)`` in a wording is one of its alternatives, ``FIELD`` one of the
fields.  Every wording gives at most ``PER_WORDING`` lines, drawn by a fixed
seed where it has more, so that the sample never grows with any input.  None
of the lines stands in the documents the model is judged on; a test sees to it.
"""

from __future__ import annotations

import functools
import itertools
import random
from http import HTTPStatus

#: The most lines one wording gives.
PER_WORDING = 48
SEED = 11

FIELDS = "headline writer full_name last_name user.email customer.name product chapter.number publisher translator isbn year publication_date item.price order_id city description subtitle company phone summary".split()

TEMPLATE = """
(Hi|Hello|Welcome back|Kind regards|Yours truly|Sincerely) (,|) [(Your|First|Last|Full|Company|Client|Recipient|Sender) Name]
[(Your|Enter|Add|Type|Insert|Put|Write) (the|your|a|an) (name|title|text|heading|subtitle|summary|description|biography|address|date|quote|dedication|author|publisher) (here|below|in this place|)]
<(enter|insert|add|type|put) (the |your |)(name|title|text|heading|subtitle|summary|description|author|date|publisher)( here|)>
(enter|insert|add|type|put|write) (the |your |a |)(FIELD|heading|subtitle|biography|quotation|summary|text) here
[(PLACEHOLDER|TBD|TBA|TBC|TODO|FIXME|TK)(: |, | - )(FIELD|cover|caption|blurb|image|text|back matter|copyright page)]
<!-- (TODO|FIXME|insert|add|placeholder|replace)(:|) (FIELD|text|caption|summary) (here|later|below|) -->
(TODO|FIXME|XXX|TBD|TBA|TK): (add|write|insert|fill in|complete|check|supply) (the |a |)(FIELD|FIELD|FIELD|section|date|cover|caption|introduction|ending|preface|summary|name of the translator)
(TODO|FIXME) (add|write|insert|fill in|complete) (the |a |)(caption|preface|ending|FIELD|section|date)
[(Book|Chapter|Section|Series|Author|Publisher|Translator|Narrator|Editor|Customer|Product|City|Street|Month|Year|Full|Last)('s|) (Name|Title|Number|Date|Address|Heading|Biography)]
[(BOOK|CHAPTER|SERIES|AUTHOR|PUBLISHER|EDITOR|YOUR|FULL|LAST) (NAME|TITLE|NUMBER|DATE|ADDRESS|HEADING) (HERE|)]
(FIELD|Price|Pages|Publisher|Language|Series)(:|=) (undefined|null|NaN|None|N/A|[object Object]|#N/A)
(undefined|null|NaN|None), (undefined|null|NaN|None)
(Total|Sum|Pages|By|From|Cost): (NaN|undefined|null|[object Object]|#NAME?|#DIV/0!|#N/A|#NUM!|#NULL!)
by (undefined|null|NaN|[object Object])( and (undefined|null)|)
=(A1|SUM(B2:B9)) #(NAME?|DIV/0!|N/A|NUM!|NULL!|SPILL!)
[object (Array|Undefined|Promise|HTMLElement)]
«(FIELD|author name|titles|narrators|authors|title of the work|narrator name)»
&lt;(FIELD)&gt;
<(FIELD|heading|caption|summary) (comes|is to go|will stand|goes) (here|below|in here|in this place)>
TK(TK|) (caption|quote|figure|date|chapter|page) TK(TK|)
TK TK(:| -|,) (caption|quote|figure|date)( TK|)
TKTK
{(FIELD)_1} (and|by|of) {(FIELD)_2}
By {1}, (told|sung|edited) by {2}
{0} (of|by|and) {1}
__(FIELD)__
%s (of|by) %s
%(FIELD)s (of|by) %(FIELD)d
[(Titel|Name|Text|Überschrift|Autor|Datum|Verlag|Beschreibung|Widmung)( des Buches| des Kapitels| des Autors|) (hier |)(eintragen|eingeben|ergänzen|einsetzen)]
(Bitte |)(Titel|Namen|Text|Überschrift|Autor|Beschreibung) (hier |)(eintragen|eingeben|ergänzen)
[(Ihr|Dein) (Name|Titel|Text)]
[(Escriba|Escribir|Introduzca|Ponga|Añadir|Inserte)( aquí|) (el|su|un) (título|nombre|autor|texto|capítulo|resumen|nombre del (libro|capítulo|editor))( aquí|)]
[(Su|Tu) (nombre|título|texto)( aquí|)]
[(Saisir|Écrire|Ajouter|Entrez|Indiquer|Mettre)( ici|) (le|un|votre) (titre|nom|texte|résumé|chapitre|nom de l’auteure|nom du livre)( ici|)]
[(Votre) (nom|titre|texte)( ici|)]
[(Inserisci|Scrivere|Aggiungere)( qui|) (il|un) (titolo|nome|testo|autore|riassunto)( qui|)]
[(Inserir|Escrever|Digite)( aqui|) (o|um) (título|nome|texto|autor|resumo)( aqui|)]
[(Wpisz|Dodaj|Podaj)( tutaj|) (tytuł|tekst|nazwisko|imię|opis)( tutaj|)]
[(Вставьте|Введите|Добавьте) (сюда |здесь |)(название|имя|текст|автора|описание)( сюда| здесь|)]
(【|[)(请在此|在这里|请在这里|请您|请)(填写|填入|添加|写入|输入)(标题|书名|作者|姓名|内容|文字|章节|说明|日期)(】|])
(在此|在此处|请在此处|此处请|此处需|这里)(输入|添加|填入|填写|补写)(标题|书名|作者姓名|内容|文字|章节名|说明|日期|文本)
(待补充|待填写|待定|内容待定)(：|)(标题|作者|内容|章节)
(【|[|)(ここに|こちらに)(説明文|見出し|名前|文章|章の名前|日付|内容|テキスト)を(書いてください|書く|入れてください|記入|記入してください|入力します)(】|]|)
(未入力|未設定|準備中)(：|)(見出し|名前|文章)
[(यहाँ|यहां) (नाम|शीर्षक|पाठ|विवरण|तारीख|पुस्तक का नाम) (दर्ज करें|भरें|डालें|जोड़ें)]
[(लेखक का नाम|पुस्तक का शीर्षक|अध्याय|परिचय) (यहाँ|यहां) (लिखें|लिखिए|दर्ज करें)]
(यहाँ|यहां) (शीर्षक|पाठ|विवरण|तारीख|पुस्तक का नाम) (दर्ज करें|भरें|डालें|जोड़ें|लिखिए)
"""

# Words of the usual pseudo-Latin filler, and of the passage it was made from.
LATIN = (
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat "
    "duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum "
    "perspiciatis unde omnis iste natus error voluptatem accusantium doloremque laudantium totam rem aperiam eaque ipsa quae ab illo inventore veritatis quasi architecto beatae vitae dicta explicabo nemo ipsam quia voluptas aspernatur aut odit fugit "
    "vestibulum curabitur pellentesque habitant morbi tristique senectus netus malesuada fames ac turpis egestas mauris fermentum donec vivamus praesent feugiat suspendisse vulputate porttitor sagittis nullam risus eget urna ornare leo"
)
FILLER = """
(This|The following) (is|text is) (dummy|filler|sample|placeholder|mock|test) (text|copy|content|paragraph) (for|to show|to fill) (the |)(layout|design|mock-up|preview|page)( only| purposes|)
(Dummy|Filler|Sample|Placeholder|Mock|Example|Test) (text|copy|content|paragraph|heading)(:|,| -|.) (replace|please replace|to be replaced|change|edit|delete) (this|it|me) (later|before printing|with (your own|the real) (text|content|copy))
(Replace|Change|Edit|Delete|Overwrite) this (text|copy|paragraph|heading|line) (later|before printing|with (your own|the real|the final) (text|content|copy))
(Your|The real|The final|Body|Main) (text|copy|content|paragraph|heading) (goes|will go|comes|is to go) here
(Heading|Subtitle|Body|Caption|Paragraph|Title|Book title|Chapter heading|Main text) (goes|comes|belongs|is set) (here|in here|(in|on|into) this (box|row|place|space|column|line))
(blah blah blah|bla bla|foo bar baz|foo bar|test test|xxx xxx|qwerty asdf|asdf jkl|asdfgh qwerty|abc abc|dummy dummy) (bla bla|foo bar|test test|xxx xxx|qwer zxcv|jkl asdf|asdf jkl|dummy)
(Das|Dies|Hier) (hier |)(ist|steht) (nur |)(ein |)(Platzhalter|Platzhaltertext|Blindtext|Beispieltext|Mustertext|Fülltext)(, der (später|noch) (ersetzt|ausgetauscht) wird| für das Layout|)
(Der|Ein) (endgültige|eigentliche|echte) (Text|Inhalt) (kommt|folgt|wird) (noch|später noch|hier (ergänzt|eingefügt))
(Texto|Párrafo|Contenido) (de (ejemplo|muestra|prueba|relleno)|provisional|simulado)(:|,) (por favor |)(reemplácelo|sustitúyalo|cámbielo|se sustituirá)( por el (suyo|definitivo|real)|)
(Esto|Este) (es solo|es sólo|es) (un |)(texto|contenido|párrafo) (provisional|de prueba|de muestra|de ejemplo)
(Ceci|Voici) (n’est qu’|est )un (faux texte|texte provisoire|texte factice|texte d’exemple|exemple de texte)( à remplacer| qui sera remplacé(e|)| pour la maquette|)
(Texte|Contenu) (provisoire|factice|d’exemple|à remplacer)(,| :) (merci de le |)(remplacer|modifier)
(Questo|Ecco) è (solo |)(un |)(testo|contenuto) (segnaposto|di prova|di esempio|fittizio)
(Este|Isto) é (apenas |só |)(um |)(texto|conteúdo) (de exemplo|provisório|fictício|de teste)
(To jest|Tu jest) (tylko |)(przykładowy tekst|tekst zastępczy|tekst próbny)
(Это|Здесь) (просто |только |)(пример текста|текст-заполнитель|пробный текст|текст-рыба)
(这里|这段|以下|此处)(只是|仅为|为|是一段|是一些)(占位|示例|测试|填充|样例|虚拟)(文本|内容|段落|用文字|文案)(，(请替换|稍后替换|仅供排版)|)
(占位文本|示例文本|测试文本|填充文本|样例内容)(，|：|)(请替换|请修改|稍后替换|仅供排版使用)
(この|ここの|以下の)(文章|テキスト|文|内容)は(ダミー|サンプル|仮のもの|見本|テスト用)(です|になります|ですので差し替えてください)
(ダミー|サンプル|仮の)(テキスト|文章|文)(です|を差し替えてください|が入ります)
(यह|ये) (केवल|सिर्फ|बस|मात्र) (नमूना|उदाहरण|परीक्षण|भराव|अस्थायी) (पाठ|सामग्री|लेख|वाक्य) (है|हैं)
(नमूना|अस्थायी) (सामग्री|पाठ)(, बाद में बदलें| को बदल दें| हटाएँ)
"""

#: Names of further server states, beside those the standard library knows by number.
STATES = "520 Web server is returning an unknown error;521 Web server is down;522 Connection timed out;523 Origin is unreachable;524 A timeout occurred;499 Client closed request;440 Login time-out"
NOTICE = """
(HTTP |Server |)Error (STATE)
(HTTP |Server |)(Error|Status|status code|response) (CODE)(:| -| –|.) (PHRASE)
HTTP/(1.1|1.0|2) (STATE)
(nginx|Apache|openresty|IIS|cloudflare)(/1.2|): (STATE)
(CODE) - (PHRASE)
(CODE)(. That’s an error.| (error|Error)| \\| (PHRASE))
(The|This|That) (page|site|document|content|address|file|chapter|article|resource) (you (requested|asked for|wanted|are trying to (reach|open|view))|) (could not be (found|loaded|displayed)|does not exist|doesn’t exist|is no longer available|is unavailable|can’t be (found|reached|displayed)|cannot be (displayed|found|opened))( on this server| at this address| right now|)
(The requested|Requested) (page|file|document|resource|object|address|content) (/index.html |/books/12 |)(could not be|cannot be|was not able to be) (found|located|loaded|served)( here| on our site|)
(Oops|Whoops|Uh-oh|Sorry|We’re sorry)(!|,|.) (something|anything) (went wrong|has gone wrong|broke)( on our (side|end)| while loading (the|this) page|)
(Oops|Whoops|Uh-oh|Sorry|We’re sorry)(!|,|.) (we couldn’t|we could not|we were unable to) (find|load|open|display) (that|this|the) (page|chapter|book|file)
(Page|File|Document|Content|Resource|Article|Address) (not available|is missing|no longer exists|does not exist|cannot be found|removed or (renamed|relocated))
(The|This) (server|site|website|service|system|application|gateway|proxy) (encountered|met|reported|returned|has encountered) (an (internal|unexpected|unknown) error|a (temporary |)(problem|error|fault))( and (could not|was unable to) (complete|finish|process|serve) (your|the) request|)
(The|This) (server|site|service|website) is (temporarily |currently |)(unavailable|down|overloaded|offline|busy|not responding|undergoing maintenance|down for maintenance)(, (please |)(try again|come back|retry) (later|soon|shortly|in a few minutes)|)
(Please |)(try again|retry|reload|refresh the page|come back) (later on|in a few minutes|after a while|in 30 seconds|shortly)(, or contact (the (administrator|webmaster)|support)|)
(An |)(internal|unexpected|unknown|fatal|critical) (server |application |system |database |)(error|exception|failure) (occurred|has occurred|was reported|happened)( while processing (your|the) request|)
(Error establishing|Failed to establish|Could not establish|Unable to establish) (a |)(database |server |)connection
(The (connection|request|gateway|upstream|server)|Your (request|connection)|Connection) (has timed out|timed out|was refused|was reset|was interrupted|has been blocked|was aborted)
upstream (request|server|connection) (timeout|error|failure|reset|refused)(, reset reason: (connection|overflow)| before headers| or disconnect|)
(You|You currently) (are not authorized|are not allowed|are not permitted|do not have (access|permission|rights)|don’t have (access|rights)|must be logged in) to (access|open|read|use|see) (this|the requested) (page|resource|content|document|directory|folder|server|file)
(Access|Permission|Authorization|Authentication) (to this (page|resource|site|server) |)(is denied|has been denied|was denied|is forbidden|is required|required|failed)(. (Reference|Incident|Event) (id|number|code):? (#|)18.2f3a|)
(Your|The|This) (login |user |browser |current |)(session|login|token|link) (has timed out|timed out|is invalid|is no longer valid|has ended|has been closed)(, please (log in|sign in|login) (again|to continue)|)
(Please |You must |You need to |)(log in|sign in|log on|login) (again |)(to (continue|read this (page|book|text)|access this content|view this page)|first)
(You have|Your address has|Your IP has|You’ve) (been (rate limited|rate-limited|blocked|throttled)|sent too many requests|exceeded (the|your) (rate |request |daily |)(limit|quota))(, (try|please try) again (later|in a few minutes|in 60 seconds)|)
(Verify|Confirm|Prove|Please verify|Please confirm) (that |)you are (a human|human|not a robot)( before (continuing|proceeding)| to continue| by completing the captcha|)
(Checking|Verifying|Inspecting) (if the site connection is secure|your connection|whether you are human)( before (you proceed|proceeding|you continue)|)(, please wait|...|)
(We have detected|Our systems have detected) (unusual|suspicious) (traffic|activity) from your (network|computer|address)
(JavaScript|Javascript|Scripting|Active scripting) (is|seems to be|appears to be|has been) (disabled|turned off|blocked|switched off|not enabled|not available|not supported)( in (your|this) browser|)(, (turn|switch) it on (to (continue|proceed)|and (refresh|reload))|)
(This|The) (page|site|website|application|app|reader|service|book|form) (needs|requires|relies on|works only with|will not work without|does not work without|depends on) (JavaScript|Javascript|scripts|scripting|cookies and scripts)(| to (run|work|function|be displayed) (correctly|properly)| to be (enabled|switched on|turned on|active))
(You|You will) (must|have to|need to|should) (enable|turn on|switch on|activate|allow) (JavaScript|Javascript|scripts|scripting|cookies)( in your (browser|settings)|) (to (use|read|view|open|see) (this|the) (page|site|app|book|content)|and (refresh|reload)|before you continue)
(Please |)(enable|turn on|switch on|activate|allow) (JavaScript|Javascript|scripting|scripts) (to (use|view|open|run|load) (this|the) (page|site|app|content|application)|for this (site|page)|and (refresh|reload) (this|the) page|in your settings)
(Your|This) browser (does not support|doesn’t support|blocks|has disabled|is too old for|is not supported, as it lacks) (JavaScript|scripts|scripting|this (site|application))
<noscript>(Turn on|Switch on|Enable|You need) (JavaScript|scripts|scripting)( to (read|see|use) (it|this))</noscript>
(Now loading|Loading (page|content|data|the chapter)|Please wait while (the page|we|the content) (loads|is loading|load))(...|…|, please wait)
Traceback (of the |)(most recent|last) (calls|call last)(:|) (in|at) (module|main|line 12)
File "(app|main|views|server|utils).py", line (12|87|203), in (main|load|run|get_page|<module>)
(ValueError|TypeError|IndexError|AttributeError|RuntimeError|ConnectionError|TimeoutError|NameError|ImportError|ZeroDivisionError|KeyError|UnicodeDecodeError)(:|) ('NoneType' object has no attribute|list index out of range|name is not defined|unsupported operand|invalid literal|'name'|'path'|connection refused)
(Uncaught |)(TypeError|ReferenceError|SyntaxError|RangeError)(:|) (undefined is not a function|x is not defined|cannot read (property|properties) of (undefined|null)|unexpected token)
(Exception in thread "main" |Caused by: |)(java.lang.|java.io.|org.apache.|javax.servlet.)(NullPointerException|IllegalStateException|IOException|RuntimeException|ServletException|OutOfMemoryError)(: null| at line 12|)
(Fatal error|Parse error|Warning|Notice|Deprecated): (Uncaught (exception|Error)|Undefined (variable|index|offset)|Call to undefined function|syntax error|mysql_connect()|include()) in (/var/www/html/|)(main|header|config|functions).php on line (12|88|140)
(SQL|Database|MySQL|ORA-00933|SQLSTATE[42000])(:|) (syntax error|error in your SQL syntax|connection failed|command not properly ended)
(Segmentation fault|Bus error|Kernel panic|Stack overflow|Out of memory)(, core dumped| (core dumped)|: killed process)
(Die|Diese) (gewünschte |aufgerufene |gesuchte |)(Seite|Datei|Adresse|Website) (existiert (nicht|nicht mehr)|wurde nicht gefunden|konnte nicht (gefunden|geladen|angezeigt) werden|ist (nicht verfügbar|nicht erreichbar|zurzeit nicht erreichbar|umgezogen))
(Seite|Datei|Inhalt|Dokument) (existiert nicht|nicht verfügbar|nicht vorhanden)(, Fehler (CODE)| (Fehler (CODE))|)
(Interner|Unbekannter|Schwerer) (Serverfehler|Fehler)(: (CODE)| auf dem Server| ist (aufgetreten|passiert)|)
(Es ist |Leider ist |)(ein|ein unerwarteter|ein interner) (Fehler|Serverfehler) aufgetreten(, (bitte |)versuchen Sie es (später |)(erneut|noch einmal)|)
(JavaScript|Scripting) (ist|wurde) (in Ihrem Browser |)(deaktiviert|ausgeschaltet|blockiert|nicht aktiviert)
(Für|Um) (diese|die) (Seite|Anwendung|Website) (wird JavaScript (benötigt|vorausgesetzt)|ist JavaScript (erforderlich|nötig)|zu (lesen|sehen|verwenden), (aktivieren Sie|schalten Sie) (bitte |)JavaScript( ein|))
(Zugriff|Zugang) (verweigert|wurde verweigert|nicht erlaubt|gesperrt)(, (Fehler|Code) (CODE)|: keine Berechtigung)
(La|Esta|Su) (página|dirección|web) (solicitada |que busca |buscada |)(no (existe|se encuentra|se encontró|está disponible)|ya no existe|ha sido (eliminada|movida))
(Error|Fallo) (CODE)(: |, |. )(la página no (existe|se encontró|está)|página inexistente|acceso (denegado|prohibido)|servicio no disponible)
(Ha ocurrido|Se produjo|Ocurrió) un (error|fallo) (interno|inesperado|desconocido)( en el servidor| del servidor|)(, (inténtelo|intente) (de nuevo |)(más tarde|otra vez)|)
(Active|Habilite|Encienda|Debe activar|Necesita activar) JavaScript (para (continuar|ver (esta|la) página|usar (este|el) sitio|seguir leyendo)|en su navegador)
(Este sitio|Esta página|La aplicación) (necesita|requiere) JavaScript( para funcionar| activado|)
(Acceso|Permiso) (denegado|no autorizado|prohibido)(: (CODE)|, no tiene permiso para ver esta página)
(La|Cette) page (demandée |que vous cherchez |recherchée |)(n’existe (pas|plus)|est introuvable|n’a pas été trouvée|n’est (pas|plus) disponible|a été (supprimée|déplacée))
(Erreur|Code) (CODE)( : |, )(page (inexistante|non trouvée)|accès (interdit|refusé)|service indisponible)
(Une|Une autre) erreur (interne|inattendue|inconnue) (est survenue|s’est produite|du serveur est survenue)(, (veuillez |)(réessayer|réessayez) plus tard|)
JavaScript (est|semble) (désactivé|bloqué|inactif)( dans (votre|ce) navigateur|)
(Activez|Merci d’activer|Vous devez activer|Il faut activer) JavaScript (pour (continuer|lire (la|cette) page|utiliser ce site|voir ce contenu)|dans votre navigateur)
(Ce site|Cette page|L’application) (nécessite|requiert|a besoin de) JavaScript( pour fonctionner|)
Accès (interdit|non autorisé|refusé à cette page|refusé, erreur (CODE))
(Pagina|Questa pagina|La pagina) (non (trovata|esiste|disponibile)|richiesta non (esiste|è stata trovata))(, errore (CODE)|)
(Attivare|Abilita|Attiva) JavaScript (nel browser|per (continuare|vedere la pagina))
(Página|Esta página|A página) (não (encontrada|existe)|solicitada não (existe|foi encontrada))(, erro (CODE)|)
(Ative|Habilite) o JavaScript (no navegador|para (continuar|ver a página))
(Pagina|De pagina) (niet gevonden|bestaat niet)(, fout (CODE)|)
(Strona|Ta strona|Podana strona) (nie (istnieje|została znaleziona)|jest niedostępna)(, błąd (CODE)|)
Nie (można|udało się) (znaleźć|odnaleźć|otworzyć) (tej |żądanej |)strony
(Proszę włączyć|Aby kontynuować, włącz) JavaScript( w (tej |swojej |)przeglądarce|)
(Страница|Эта страница|Запрошенная страница) (не (существует|была найдена|может быть найдена)|недоступна|удалена)(, ошибка (CODE)|)
(Ошибка (CODE)|Внутренняя ошибка сервера|Доступ (запрещён|запрещен))(: страница не (найдена|существует)|, попробуйте позже|)
(Включите|Для работы сайта включите|Чтобы продолжить, включите) JavaScript( в (вашем|настройках) браузере(а|)|)
(您|你)(请求|查找|要找|所访问)的(页面|网页|内容|文件)(找不到了|无法找到|无法显示|不存在|已被移除|暂时无法访问)
(页面|网页|该网页|此页面)(找不到|未找到|无法打开|无法加载|走丢了|已删除)(（错误(CODE)）|，错误码(CODE)|)
(服务器|系统|网站)(内部|发生|出现|遇到)(了|)(错误|异常|未知错误)(，请(稍后|过会儿)(再试|重试)|)
(错误|错误码|状态码)(：|)(CODE)(，| )(禁止访问|服务不可用|网关超时|页面未找到)
(请|您需要|必须|请先)(启用|打开|开启|允许)(浏览器的|浏览器中的|)(JavaScript|脚本|脚本功能)(，然后刷新(页面|)|才能(继续|阅读|使用|正常运行)|以(继续|正常显示)|)
(本网站|本站|此页面|该应用|本页)(需要|必须)(启用|开启|使用|支持)(JavaScript|脚本)(才能(运行|显示|正常(运行|工作|使用))|)
(您的|当前)(登录|会话|访问)(已过期|已失效|被拒绝|受限)(，请重新登录|)
(没有|无|您没有)(访问|查看)(权限|该页面的权限)
(お探しの|指定された|アクセスした|この)(ページ|ファイル|記事)(は|が)(見つかりません(でした|)|存在しません|削除されました|ありません|表示できません)(（エラー(CODE)）|)
(サーバー|システム)(で|に|内部)(エラー|障害|問題)が(発生しました|起きました|あります)(。(しばらくして|後で)(再度|もう一度)お試しください|)
(このサイト|このページ|本サイト|アプリ)(を(利用|表示|使用)する|の(利用|表示))には(、|)(JavaScript|スクリプト)(が必要です|を有効にする必要があります|をオンにしてください)
(ブラウザの|お使いのブラウザの|設定で)(JavaScript|スクリプト)(が無効です|を有効にして(再読み込みしてください|お読みください|)|が無効になっています)
(アクセス|閲覧)(が拒否されました|の権限がありません|ができません)(（(CODE)）|)
(表示|閲覧)権限がありません
(サーバー|システム|सर्वर|इस साइट) (में|पर) (आंतरिक|अज्ञात|कोई|तकनीकी) (त्रुटि|समस्या|गड़बड़ी) (हुई|आई|हो गई) (है|)
(यह|आपका|माँगा गया|अनुरोधित) (पृष्ठ|पेज) (उपलब्ध नहीं|मौजूद नहीं|अब उपलब्ध नहीं|हटा दिया गया) (है|)(, त्रुटि (CODE)|)
(जारी रखने के लिए|इस पृष्ठ के लिए|पढ़ने के लिए) (अपने ब्राउज़र में |)(जावास्क्रिप्ट|JavaScript) (चालू करें|सक्षम करें|ज़रूरी है|आवश्यक है)
(पहुँच|प्रवेश) (अस्वीकृत|वर्जित|निषिद्ध)(, त्रुटि (CODE)|)
"""

#: Real prose that only speaks of such things, notes in brackets, and page furniture.
PROSE = """
(“Access denied,”|“Not found,”|“Forbidden,”|“Denied,”|“Unavailable,”|“Too many,”|“Sorry,”) (said|wrote|cried|muttered|answered|replied) the (guard|clerk|judge|baker|widow|captain|nurse|boy), (and|but|while) the (gate|lamp|window|cart|letter|drawer) (stayed|remained|was left) (shut|dark|open|where it was)
(“Sorry,”|“Please,”) said the (guard|clerk|nurse|baker), “(the|that) (house|coin|road|hat|ring) you are looking for (is|went|fell) (behind|under|over) the (wall|cart|bridge)
(The|That|His|Her) (page|letter|title|name|chapter|book) was (not|never) found(, though|; instead|, and) (they|she|the old man|the clerk) (searched|looked through|counted) the (attic|cellar|stable|library)( for (three|CODE) (days|hours)| again|)
(The|This|One) (page|sheet|leaf) was (intentionally |)left (blank |)(by|to|for) the (printer|bishop|clerk|widow)(, who (burned|kept|read) it|)
(The|Her|His) (service|shop|school|road|ferry) was (unavailable|closed|not to be had) on (Sundays|feast days|market days), when the (priest|miller|cook|driver) (slept|was away|went fishing)
(Try|Come|Look) again (later|tomorrow|in spring), (said|read|wrote) the (note|sign|clerk|card) on the (door|wall|gate|table)(, (so|and) (she|he|the widow) (tried|came|looked) again|)
(Please|Kindly) enable the (horse|child|widow|baker) to (rest|eat|see|sleep), (said|begged|whispered) the (nurse|cook|clerk); the (scripts|cookies|pages|servers) (can|must|may) wait
(He|She|They|The clerk) (chalked|painted|wrote|carved) (CODE) on the (wall|gate|barrel|board) and (left|went home|locked the cellar|counted the sacks)
(“Insert|“Put|“Enter|“Add) the (coin|letter|ring|card) here,” (said|whispered|answered) the (old|small|tired) (clerk|child|nurse), and the (lid|gate|wall) (opened|moved|gave way)
(The|An|One) error in the (old|long|first) (reckoning|account|map|letter) (cost|lost|spared) them (three|two|{2, 4}) (ships|days|sacks|horses)
(Written|Told|Read|Translated|Sung|Edited|Printed) by (M. Brown|Ann Hill|P. de la Cour|C. Weber|J. K.|the author of The Gate|an unknown (pen|poet)|a lady|陈远|김 민수)
(By|From|After|One|A letter from|Some|The work of) (an |the |two |)unknown (pen|poet|writer|painter|woman|sailor|voice|hands|hands|hands)
(The|This|Her|An old) (text|writing|ink|script|copy) (here |)is (hard|easy|pleasant|faint) to (read|follow|see|copy)(, and the (printer|clerk) (is|was|had been) (tired|asleep)|)
(Le|Ce) (titre|texte|nom|chapitre) du (poème|roman|journal) (lui|leur) (semblait|paraissait|manquait) plus (beau|long) que le (poème|roman)
(Der|Dieser) (Titel|Text|Name) des (Gedichts|Romans) (gefiel|schien) ihr (besser|länger) als das (Gedicht|Ende)
(El|Este) (título|texto|nombre) del (poema|diario) le (gustaba|parecía) más que el (poema|diario)
(An|The|Her|His|A|No|Some) (old|unknown|steady|cold|white|small|kind|good) (hand|head|face|heart|voice|name|eye|door|night|word|friend|letter|request|service) (and|on|of|in|by|with|from) (the|her|his|my|an unknown) (hand|table|window|house|mother|road|hands|land|servant|page)
(He|She|They|It|I|We) (held|took|had|gave|found|knew|told|loved|left|could not find) (it|him|her|them|the place|the way|the page) (by|in|with|at|to) (hand|the hand|the handle|the end|heart|night|the window|the servant|the author)( again| at last| before| and was gone|)
Of {(bread|gold|stone), (wine|silver|wood), (salt|tin|clay)} the (widow|judge|baker) (took|kept|chose) the (last|first|middle one)
The (printer|typesetter|apprentice) (kept|put|lost) the (brace|bracket|asterisk) ({|}|*|[|]) in the (lower|upper|wrong) case( and (the other|its fellow) elsewhere|)
The (price|rent|toll) was (%12|$14|5%|CODE), the (cover|hem|roof) <(worn|lost|mended)>, the (lamp|horse|cook) (old|patient|cross)
(His|Her|The author’s|The owner’s) name is (left out|wanting|missing) here [see the (note|list|plate) on p. (12|87)], (as|and) (the date|the place|the title) (is|too)
(All|Many) names of (streets|ships|inns) were left blank, as (was the custom|the law was): (Mr|Mrs|Dr). ——, of ——
The (sign|board|flag) read <<(BAKER|MILLS|ROSE) & (SONS|CO|DAUGHTERS)>>, in (gold|red|old) letters
(She|He|The tailor) cut the (template|pattern|model) for the (coat|boat|gate) from (an old|a borrowed|the last) (curtain|map|board)
(The|A) (reader|listener)(’s| from abroad|) (note|letter): the (old|former) (player|site|page) (needed|wanted) (JavaScript|cookies), the new one (starts|opens|plays) (at once|quickly|without), and (chapter|part) (12|4) is my favourite
(The inscription|The coin|The ring|A label) (read|said|bore) (LOREM|IPSUM|DOLOR|NULL|ERROR), and no (clerk|child|priest) knew what it meant
The (bishop|teacher|monk) (murmured|said|sang) “(dolor, dolor|amen, amen|ipsum, ipsum)” over the (grave|cradle|loaf)
(She|He) had (reached|come to) the (book’s|story’s|letter’s) end, and nothing was (undefined|unknown|blank|null) any more but the (sea|road|name)
[Illustration: (a|the) (red|small|broken|old) (boat|gate|lamp|wheel)]
[Footnote (3|12|41): (In the|The) (first|older|second) (edition|printing|copy) (has|reads|gives) “(gate|wall|hour)”( here|)]
[(Transcriber|Editor|Translator|Publisher)’s note: (spelling|accents|errors|punctuation) (corrected|left as printed|unchanged)]
[(Music|Laughter|Thunder|A bell|The curtain) (plays|rises|falls|is heard|outside)]
[(Sidenote|Plate|Figure|Map|Frontispiece|Decoration): (the|a) (harbour|castle|garden|market)]
(READER|SINGER|FIRST WITNESS) [(loudly|aside|weeping)]: (The|My|A) (horse|lamp|letter) (fell|burned|came back)
(CLERK|WIDOW|JUDGE): (You|I|We) (forgot|found|lost) (my|your|the) (horse|key|place)!
(Thank you|Thanks) (for|so much for) (the|this) (Bridge|Castle|book|recording)
(This|The) (recording|reading|copy|edition) of The (Bridge|Castle|Garden) (was made|is|comes) from (an edition|a copy|a printing) of (1820|1851)
(Unabridged|Abridged|Complete), (12|30) (chapters|parts|sections), (9|14) (h|hours) (20|45) (min|minutes)
(Home|Start|Shelf|Library|Search|Log in|Account) \\| (Books|Authors|Help|About|Contact|Terms) \\| (News|More|Menu|Blog)
(Back to|Return to|Go to) the (library|list|top|first chapter|shelf)
(Previous|Next) (chapter|part|book|section)
© (the library|the readers|our shelf|1990)
(Volver a la biblioteca|Zurück zur Liste|Retour à la liste|トップへ戻る|返回书架|वापस जाएँ)
(Inhalt|Índice|Sommaire|目录|目次|विषय-सूची)
In (section|chapter|part) (4|22) the (reader|narrator) (says|reads) “(lamp|boat|wheel)” where the (page|book|text) has “(gate|horse|coat)”
(A listener|Someone|Martha|Our reader) asked for (a slower|a faster|another) (pace|voice|reading) in (part|chapter) (12|30); the new (build|version|recording) is 4 percent (longer|shorter)
(Zugang|Eintritt) (verboten|verwehrt), (sagte|rief|schrieb) der (Wächter|Müller|Richter) (vor|hinter|neben) (dem Tor|der Mauer|dem Haus)
(Die|Eine) Seite (fehlte|war leer|war zerrissen), (und|doch) (der Müller|die Witwe|das Kind) (lachte|schwieg|weinte)
(La|Cette) page (manquait|était vide|était déchirée), (et|mais) (le juge|la veuve|l’enfant) (riait|se taisait)( aussi|)
(La|Esta) página (faltaba|estaba vacía|estaba rota), (y|pero) (el juez|la viuda|el niño) (reía|callaba)( también|)
(他|她|老人)在(书里|信里|册子里)(找不到|没有找到)(那一页|那个名字|那一行)，(便|只好)(合上了书|走出了门|睡了)
(彼|彼女|老人)は(本|手紙)の(そのページ|一行)を(見つけられ|読め)ず、(窓を閉めた|黙っていた|眠った)
(उसने|बूढ़े ने) (किताब|चिट्ठी) (में वह पन्ना|का नाम) (नहीं पाया|खोजा), (और|फिर) (चुप रहा|सो गया)
(CHAPTER|PART|BOOK|ACT) (IV|XII|THE SECOND|ONE)(. (The|A) (Gate|Storm|Letter|Wedding)|)
Anno (1790|1812)
(March the third|Am 3. Mai 1840|Le 4 juin|El 5 de julio)
(7|12|30) (horses|sacks|ships|years)
"""

def _parts(wording: str) -> list:
    """A wording as a list of texts and of lists of alternatives, each again a wording."""
    out, depth, begin, at = [], 0, 0, 0
    while at < len(wording):
        if wording[at] == "\\":
            at += 2
            continue
        if wording[at] == "(":
            if depth == 0:
                out.append(wording[begin:at])
                begin = at + 1
            depth += 1
        elif wording[at] == ")" and depth:
            depth -= 1
            if depth == 0:
                out.append(_alternatives(wording[begin:at]))
                begin = at + 1
        at += 1
    out.append(wording[begin:])
    return out


def _alternatives(inner: str) -> list[str]:
    out, depth, begin = [], 0, 0
    for at, c in enumerate(inner):
        depth += (c == "(") - (c == ")")
        if c == "|" and depth == 0 and inner[at - 1 : at] != "\\":
            out.append(inner[begin:at])
            begin = at + 1
    return [*out, inner[begin:]]


def _states() -> list[tuple[str, str]]:
    of_library = [(str(s.value), s.phrase) for s in HTTPStatus if s.value >= 400]
    return of_library + [tuple(s.split(" ", 1)) for s in STATES.split(";")]


def _draw(wording: str, rng: random.Random, state: tuple[str, str]) -> str:
    """One line of a wording: a drawn alternative at every choice."""
    out = []
    for part in _parts(wording):
        if isinstance(part, str):
            out.append(part.replace("\\|", "|"))
            continue
        chosen = rng.choice(part)
        if chosen == "FIELD":
            field = rng.choice(FIELDS)
            chosen = rng.choice((field, field.upper().replace(".", "_"), field.replace(".", " ").replace("_", " ")))
        elif chosen in ("CODE", "PHRASE", "STATE"):
            chosen = {"CODE": state[0], "PHRASE": state[1], "STATE": " ".join(state)}[chosen]
        else:
            chosen = _draw(chosen, rng, state)
        out.append(chosen)
    return "".join(out)


def spelled_out(wordings: str) -> list[str]:
    """Up to ``PER_WORDING`` different lines of each wording."""
    rng = random.Random(SEED)
    states = _states()
    out: dict[str, None] = {}
    for wording in wordings.strip().splitlines():
        seen: dict[str, None] = {}
        for i in range(3 * PER_WORDING):
            if len(seen) >= PER_WORDING:
                break
            seen[" ".join(_draw(wording, rng, states[(i * 7) % len(states)]).split())] = None
        out |= seen
    return list(out)


def latin_filler() -> list[str]:
    """Sentences of the filler's words in drawn order, as filler makers write them."""
    rng, words = random.Random(SEED), LATIN.split()
    out = []
    for _ in range(12 * PER_WORDING):
        drawn = rng.sample(words, rng.randint(6, 14))
        out.append(drawn[0].capitalize() + " " + " ".join(drawn[1:]) + ".")
    at = 0
    for size in itertools.cycle((7, 9, 11)):  # and the words in their usual order
        if at >= len(words):
            break
        out.append(" ".join(words[at + 1 : at + size]).capitalize() + ", " + words[(at + size) % len(words)] + ".")
        at += size
    return out


@functools.lru_cache(maxsize=1)
def labelled() -> dict[str, list[str]]:
    """The whole sample by kind: template, filler, notice, prose."""
    return {"template": spelled_out(TEMPLATE), "filler": [*spelled_out(FILLER), *latin_filler()], "notice": spelled_out(NOTICE), "prose": spelled_out(PROSE)}
