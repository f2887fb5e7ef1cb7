"""Messages of real software and real sentences, written down from general knowledge before the rules were widened.

``held`` tells the half that the rules were not tuned on: an even number of letters. The figures of both halves are in README."""

MESSAGES = """
Just a moment...
Whoops, looks like something went wrong.
This site can't be reached.
INSERT_TITLE_HERE
{{ user.first_name | default: 'friend' }}
Page not available.
Este sitio requiere JavaScript.
Error establishing a database connection
The page isn't redirecting properly
This page isn't working
Aw, Snap! Something went wrong while displaying this webpage.
Sorry, you have been blocked
Please stand by, while we are checking your browser...
DDoS protection by Cloudflare
Attention Required! | Cloudflare
Checking if the site connection is secure
Enable JavaScript and cookies to continue
You need to enable JavaScript to run this app.
We're sorry but this application doesn't work properly without JavaScript enabled. Please enable it to continue.
JavaScript is required to use this site.
This website requires JavaScript to function.
It appears your browser has JavaScript turned off.
Your browser does not support JavaScript!
Please turn on JavaScript in your browser settings and refresh the page.
JavaScript seems to be disabled in your browser.
Bitte aktivieren Sie JavaScript in Ihrem Browser.
Diese Seite benötigt JavaScript.
Diese Website funktioniert nur mit aktiviertem JavaScript.
Veuillez activer JavaScript pour continuer.
Ce site nécessite JavaScript pour fonctionner.
JavaScript est désactivé dans votre navigateur.
Por favor, habilite JavaScript en su navegador.
Necesita activar JavaScript para ver esta página.
请在浏览器中启用JavaScript。
此网站需要启用JavaScript才能正常运行。
您的浏览器不支持JavaScript
404 Not Found
403 Forbidden
500 Internal Server Error
502 Bad Gateway
503 Service Temporarily Unavailable
504 Gateway Time-out
HTTP Error 404
Error 1020
HTTP Status 500 – Internal Server Error
Service Unavailable
Access Denied
You don't have permission to access this resource.
You do not have permission to access / on this server.
The requested URL was not found on this server.
The requested URL /index.php was not found on this server.
The server encountered an internal error or misconfiguration and was unable to complete your request.
The server is temporarily unable to service your request due to maintenance downtime or capacity problems. Please try again later.
Oops! That page can't be found.
It looks like nothing was found at this location. Maybe try a search?
The page you are looking for doesn't exist.
Sorry, the page you requested could not be found.
The page you were looking for has been moved or deleted.
We can't find the page you're looking for.
This page could not be found.
Sorry, this page isn't available.
This content isn't available right now
This video is unavailable
This post has been deleted.
The link you followed may be broken, or the page may have been removed.
No results found.
Something went wrong. Please try again.
An error occurred while processing your request.
An unexpected error has occurred.
A server error has occurred.
There has been a critical error on this website.
Briefly unavailable for scheduled maintenance. Check back in a minute.
We'll be back soon!
Our site is currently down for maintenance.
This site is under construction
Account suspended
This account has been suspended. Contact your hosting provider for more information.
Your connection was interrupted
Session expired. Please log in again.
Your session has expired due to inactivity.
You must be logged in to view this page.
Please log in to continue.
You need to sign in to view this content.
Too many requests. Please slow down.
You have exceeded your request limit.
Rate limit exceeded
Are you a robot?
Please complete the security check to access this website.
Verify you are human by completing the action below.
Unusual traffic from your computer network
Application error: a client-side exception has occurred (see the browser console for more information).
Server Error (500)
Not Found
Forbidden
Seite nicht gefunden
Die angeforderte Seite konnte nicht gefunden werden.
Diese Seite existiert leider nicht.
Ein unerwarteter Fehler ist aufgetreten.
Wartungsarbeiten: Bitte versuchen Sie es später noch einmal.
Zugriff verweigert
Page non trouvée
La page que vous recherchez n'existe pas.
Une erreur est survenue.
Accès interdit
Ce service est temporairement indisponible.
Página no encontrada
La página que busca no existe.
Ha ocurrido un error inesperado.
El servicio no está disponible en este momento.
页面未找到
您访问的页面不存在
服务器错误
系统维护中，请稍后再试。
Fatal error: Uncaught Error: Call to undefined function get_header()
Warning: Undefined variable $title in /var/www/html/index.php on line 12
Notice: Undefined index: id in /home/site/page.php on line 3
Traceback (most recent call last):
java.lang.NullPointerException
Parse error: syntax error, unexpected end of file
Lorem ipsum dolor sit amet, consectetur adipiscing elit.
Sed ut perspiciatis unde omnis iste natus error sit voluptatem accusantium doloremque laudantium
Hello world!
Welcome to WordPress. This is your first post. Edit or delete it, then start writing!
This is an example page. It's different from a blog post because it will stay in one place.
Just another WordPress site
Your content goes here.
Your text goes here. Edit or remove this text inline.
Click edit button to change this text.
Insert your text here
[Insert company name here]
Enter your description here
Add your text here.
Type your text here
Description goes here
TODO: write introduction
TBD
Placeholder text
Sample text
This is a placeholder.
Coming soon
Dear {first_name},
Dear [Name],
Hi %FIRSTNAME%,
Hello {{name}}, thank you for your order.
Hello ${user.name}!
<%= @title %>
{% block content %}
{{ page.title }}
{{product.name}}
[YOUR NAME]
<your-email@example>
<INSERT DATE>
[Company Name]
{0} items found
%s has sent you a message
__TITLE__
@@TITLE@@
${project.version}
#{user.name}
[[Title]]
[%title%]
undefined
NaN of undefined
[object Object]
Posted by null
Price: $undefined
Hier steht Ihr Text.
Platzhaltertext
Das ist ein Blindtext.
Votre texte ici
Ceci est un texte d'exemple.
Texte de remplissage
Su texto aquí
Este es un texto de ejemplo.
Texto de relleno
在此处输入文字
这里是占位文本
点击此处添加标题
""".strip().split("\n")

SENTENCES = """
The upload failed with 502 Bad Gateway, so we restarted the node and the job finished.
Samples were sent to a team at [Sanger] for sequencing.
We enable JavaScript in the report so the plots can be zoomed.
Try again later if the queue is full.
The old page was removed because its numbers were wrong.
We could not find the gene in any of the assemblies.
No results were found for the second haplotype, which surprised us.
The service was unavailable for two hours on Monday while disks were swapped.
The session on phasing has moved to room four.
Our site is being moved to a new host this week.
The document describes how the error rate is estimated.
Access to the freezer is denied to visitors without a badge.
When the server returns 404, the client tries the mirror.
The script needs permission to write to the folder.
A 500 error means that the handler raised an exception.
The reads could not be found in the archive, so we sequenced the sample again.
Please try again with a smaller block size if memory runs out.
Please log in to the cluster with your usual key before starting the job.
You must be logged in to the cluster to start a job, and the key must be in place.
The browser shows the graph as an image and needs no plug-in.
JavaScript is used for the interactive figures only.
The viewer was written in JavaScript and later ported to Rust.
The template engine replaces {{ title }} by the name of the page.
Use {sample} in the path to insert the sample name.
The variable ${HOME} is expanded by the shell.
Write <name> in place of the name of your file.
In Python, %s is replaced by the string.
Lorem ipsum is a filler text that printers have used for centuries.
The placeholder text was replaced before publication.
The author [Smith] reported a similar length.
See [methods] for the details of the extraction.
Values in [brackets] are confidence intervals.
The array has shape [batch, length] in memory.
Each row of the matrix A[i] holds one read.
The report was written by the group in Lyon [12].
The XXX locus is on the long arm.
Chromosome XX individuals were excluded.
The TODO list of the project is kept in the wiki.
The remaining work is listed below as to do.
What is the best way to trim the ends?
Why did the job fail?
The table below gives the length of each contig.
The error was an unexpected end of file in the second archive.
An error occurred twice during base calling, and both runs were repeated.
The traceback points to a missing index.
The null model assumes equal rates.
Undefined bases are written as N.
Their value is undefined when no read covers the site.
The object is passed to the next step as a list.
We will be back in the laboratory in May.
Two flow cells are coming soon from the supplier.
The first post of this series explains the method.
Hello everyone, here are the minutes of the meeting.
Dear all, the run has finished and the data are on the share.
Thank you for your order form; the cells will arrive on Friday.
The example page in the manual shows a long insertion.
The description of the sample is given in table two.
Your question about the overlaps was answered in the last release.
Is your sequence shorter than the window?
The text of the licence is in the archive.
Here is the text of the letter we sent.
The summary goes into the first section and the tables into the appendix.
Replace the default value with the one in the table.
Edit the configuration file, then start the daemon.
Click on a node to see its neighbours.
Enter the length of the window in bases.
Add your samples to the sheet before Friday.
The limit of two thousand requests a day has never been reached.
The rate limit protects the archive against accidental loops.
Their quota was raised to four terabytes.
Robots move the plates between the incubator and the reader.
The security check at the gate takes ten minutes.
A moment later the signal dropped to zero.
Just a moment of inattention can spoil the library.
The construction site next door caused vibrations during the run.
The gateway between the two networks was replaced in June.
It took us a while to find that page in the old manual.
The link between coverage and identity is weak.
The account in the paper differs from ours.
The maintenance of the sequencer costs a lot.
He was blocked from the queue because his jobs used too much memory.
The forbidden region of the plot is drawn in grey.
The service desk answers within a day.
The page number is missing in the second reference.
Nothing was found at this locus in the second sample.
Something went wrong in the third run, probably the pump.
Die Seite des Gens auf dem Chromosom ist bekannt.
Der Zugriff auf die Daten erfolgt über das Portal.
Wir haben JavaScript in der Ansicht abgeschaltet, damit sie schneller lädt.
Der Fehler trat erst bei langen Fragmenten auf.
Die angeforderte Länge wurde nicht erreicht, weil die DNA zerbrochen war.
La page suivante montre la longueur des contigs.
Le serveur était indisponible pendant la nuit, et les calculs ont repris le matin.
Nous avons activé JavaScript pour les figures.
Une erreur de lecture est survenue dans la deuxième série.
La página siguiente muestra la profundidad de cada contig.
El servidor no estuvo disponible durante la noche y los cálculos siguieron por la mañana.
Activamos JavaScript solo para las figuras.
No se encontró la secuencia en ninguna de las muestras.
服务器昨晚重启后任务继续运行。
该页面介绍了组装的步骤。
我们在报告中使用JavaScript绘制图形。
样本的访问权限由管理员分配。
The server answered with 503 for an hour, and the transfer was repeated at night.
The help page explains what "access denied" means and whom to ask.
If you see a message that scripts are disabled, use another browser.
The notice that JavaScript must be enabled comes from the old viewer.
They saw the page saying that the site was down for maintenance.
I got a forbidden error yesterday, but today the download works.
Users who are not signed in cannot see the private samples.
The old link is broken; the new one is in the readme.
A contig that cannot be found in the index is reported as missing.
The file you are looking for is in the second folder of the archive.
The requested coverage was reached after three flow cells.
Pages that do not exist are redirected to the start page since May.
We apologize to the reader for the length of this section.
""".strip().split("\n")


def held(text):
    return len(text) % 2 == 0
