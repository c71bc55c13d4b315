"""Labelled residue exemplars (fixed values): publicly known default texts of servers, browsers, page builders and templates.

Labels: ``error`` (error pages), ``script`` (notices that scripts or cookies are needed), ``filler`` (dummy text), ``form``
(unfilled issue, page and document templates), ``unfilled`` (marks that only a template engine or its user should have
replaced; the marks are named by :mod:`.residue`), ``frame`` (navigation around a page; neither content nor residue).
"""

from __future__ import annotations

ERROR = (
    "404 Not Found. The requested URL was not found on this server. If you entered the URL manually please check your spelling and try again.",
    "The requested resource could not be found but may be available again in the future.",
    "This page could not be found. The page you are looking for does not exist, has been moved, had its name changed, or is temporarily unavailable.",
    "Oops! That page can't be found. It looks like nothing was found at this location. Maybe try a search?",
    "Sorry, we couldn't find that page. The link you followed may be broken, or the page may have been removed. You may have mistyped the address.",
    "We are sorry, but the content you requested is no longer available or has been deleted. This item was removed by its owner.",
    "403 Forbidden. You don't have permission to access this resource on this server. Access is denied.",
    "Access denied. You do not have authorization to view this page. Please contact the site administrator to request access.",
    "You need access. Ask for access, or switch to an account with permission. Request access from the owner to open this file. If you think this is an error, email the site owner or workspace administrator and include the reference number.",
    "401 Unauthorized. This server could not verify that you are authorized to access the document requested. Login required. You must be logged in to view this page.",
    "Your session has expired or timed out due to inactivity. You have been logged out. Please log in again to continue. Sign in again to see this page.",
    "400 Bad Request. Your browser sent a request that this server could not understand. Invalid request.",
    "408 Request Timeout. The server timed out waiting for the request. 405 Method Not Allowed. 410 Gone.",
    "429 Too Many Requests. You have exceeded the rate limit. You have sent too many requests from this IP address in a given amount of time. Please slow down. Wait a few seconds or minutes before you retry.",
    "500 Internal Server Error. The server encountered an internal error or misconfiguration and was unable to complete your request. An error occurred while processing or rendering your request or this page.",
    "502 Bad Gateway. The proxy server received an invalid response from an upstream server. The server encountered a temporary error and could not complete your request. Please try again in 30 seconds.",
    "503 Service Unavailable. The server is temporarily unable to service your request due to maintenance downtime or capacity problems. Please try again later.",
    "504 Gateway Timeout. The gateway did not receive a timely response from the upstream server. The server did not respond in time or took too long to respond.",
    "We'll be back soon! Sorry for the inconvenience but we are performing some maintenance at the moment. We will be back online shortly. The site is down for scheduled maintenance. Doing maintenance.",
    "Something went wrong on our end. An unexpected error has occurred. Please try again in a few minutes. If the problem persists, contact support. Oops, an error occurred.",
    "This site can't be reached. The connection was reset. The connection to the server was reset while the page was loading. The server unexpectedly closed the connection. ERR_CONNECTION_RESET. Code",
    "The connection has timed out. The server is taking too long to respond. The site could be temporarily unavailable or too busy. Check your network connection.",
    "Checking your browser before accessing the site. This process is automatic. Your browser will redirect to your requested content or open the page shortly. Please allow up to 5 seconds, this takes a few seconds.",
    "Please verify you are a human by completing the action below. Needs to review the security of your connection before proceeding. Complete the CAPTCHA to continue.",
    "Sorry, you have been blocked. You are unable to access this site. This website is using a security service to protect itself from online attacks. Ray ID",
    "Application error: a client-side exception has occurred. See the browser console for more information. An error occurred in the application and your page could not be served.",
    "TypeError: cannot read properties of undefined. AttributeError: 'NoneType' object has no attribute. Traceback most recent call last. Uncaught exception. NullPointerException.",
    "Error establishing a database connection. There has been a critical error on this website. Fatal error. Warning: cannot modify header information.",
    "This XML file does not appear to have any style information associated with it. AccessDenied. NoSuchKey. The specified key does not exist. Request has expired.",
    "Failed to load resource. Unable to load the page. Could not load content. Nothing to see here. No results were found. We couldn't find what you're looking for. There is nothing here.",
    "Welcome to nginx! If you see this page, the web server is successfully installed and working. Further configuration is required. It works! This is the default web page for this server. Index of parent directory.",
    "This domain is for sale. Domain parked. Account suspended. This account has been suspended. Contact your hosting provider for more information.",
    "Seite nicht gefunden. Die angeforderte Seite konnte nicht gefunden werden. Bitte überprüfen Sie die Adresse. Der Link ist falsch oder veraltet. Die Seite wurde verschoben oder gelöscht.",
    "Der Dienst ist vorübergehend nicht verfügbar oder antwortet nicht. Bitte versuchen Sie es später erneut. Fehler 503. Interner Serverfehler. Der Server antwortet nicht. Bitte später noch einmal versuchen.",
    "Ihre Sitzung ist abgelaufen. Bitte melden Sie sich erneut an. Bitte neu anmelden. Zugriff verweigert. Sie haben keine Berechtigung, auf diese Seite zuzugreifen. Es ist ein Fehler aufgetreten.",
    "Page introuvable. La page que vous recherchez n'existe pas ou a été déplacée. L'adresse saisie est peut-être incorrecte ou erronée. Erreur 404.",
    "Service momentanément indisponible. Une erreur est survenue. Veuillez réessayer plus tard. Erreur interne du serveur. Erreur 503 : le service est temporairement indisponible.",
    "Votre session a expiré. Veuillez vous reconnecter. Accès refusé. Vous n'avez pas l'autorisation d'accéder à cette page.",
    "Página no encontrada. La página que busca no existe o ha sido movida. Compruebe que la dirección web es correcta. La página ya no existe o el enlace está roto. Error 404.",
    "Servicio no disponible temporalmente. El servicio no responde. Ha ocurrido un error. Inténtelo de nuevo más tarde. Error interno del servidor. Error 503.",
    "Su sesión ha caducado. Inicie sesión de nuevo. La sesión ha expirado. Acceso denegado. No tiene permiso para acceder a esta página.",
)

SCRIPT = (
    "You need to enable JavaScript to run this app.",
    "JavaScript is disabled in your browser. Please turn on or enable JavaScript to view and read this page, then reload or refresh the page.",
    "For full functionality of this site it is necessary to enable JavaScript. Here are the instructions how to enable JavaScript in your web browser.",
    "This site requires JavaScript and scripts to work correctly. Please allow or enable scripts for this site and refresh. The viewer could not be loaded.",
    "Sorry, this application or page does not work properly without JavaScript enabled. Please enable it to continue.",
    "We've detected that JavaScript is disabled in this browser. Please enable JavaScript or switch to a supported browser to continue.",
    "JavaScript must be enabled in order for you to use this. However, it seems JavaScript is either disabled or not supported by your browser.",
    "Please enable cookies and reload the page. Your browser must accept cookies. Cookies are disabled in your browser. Allow cookies.",
    "Please disable your ad blocker or content blocker, then turn it off and reload the page. It looks like you are using an ad blocker.",
    "Enable JavaScript and cookies to continue. Please turn JavaScript on and reload the page.",
    "Your browser is not supported or out of date. Please upgrade to a modern browser.",
    "Loading... Please wait while the page is loading. If nothing happens or the page does not load, scripting or JavaScript may be disabled. Click here if you are not redirected.",
    "Bitte aktivieren Sie JavaScript in Ihrem Browser, um diese Seite anzuzeigen oder zu nutzen. Diese Anwendung oder Seite läuft nur mit eingeschaltetem JavaScript. JavaScript ist deaktiviert. Aktivierte Skripte sind erforderlich.",
    "Veuillez activer JavaScript dans votre navigateur pour afficher cette page. Cette application nécessite JavaScript et a besoin de scripts pour fonctionner. JavaScript est désactivé.",
    "Active JavaScript en su navegador para ver esta página. Habilite JavaScript para continuar. Esta aplicación necesita o requiere JavaScript y scripts para funcionar. JavaScript está desactivado.",
)

FILLER = (
    "Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore et dolore magna aliqua. Ut enim ad minim veniam, quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat. Duis aute irure dolor in reprehenderit in voluptate velit esse cillum dolore eu fugiat nulla pariatur. Excepteur sint occaecat cupidatat non proident, sunt in culpa qui officia deserunt mollit anim id est laborum.",
    "Sed ut perspiciatis unde omnis iste natus error sit voluptatem accusantium doloremque laudantium, totam rem aperiam, eaque ipsa quae ab illo inventore veritatis et quasi architecto beatae vitae dicta sunt explicabo. Nemo enim ipsam voluptatem quia voluptas sit aspernatur aut odit aut fugit, sed quia consequuntur magni dolores eos qui ratione voluptatem sequi nesciunt.",
    "At vero eos et accusamus et iusto odio dignissimos ducimus qui blanditiis praesentium voluptatum deleniti atque corrupti quos dolores et quas molestias excepturi sint occaecati cupiditate non provident, similique sunt in culpa qui officia deserunt mollitia animi, id est laborum et dolorum fuga.",
    "Lorem ipsum dolor sit amet, consetetur sadipscing elitr, sed diam nonumy eirmod tempor invidunt ut labore et dolore magna aliquyam erat, sed diam voluptua. Stet clita kasd gubergren, no sea takimata sanctus est. Vivamus vestibulum lectus nullam quis sollicitudin vel vorem sodales.",
    "Section title. Heading. Item one. Lorem ipsum. Your text goes here. Sample text. Some text here. Placeholder text. Example text. Dummy text. Add text.",
    "Click here to add text. Click to edit title. Double-click to edit. Your title here. Your headline here. Insert your text here. Add your content here. Add a description.",
    "Hello world! Welcome to WordPress. This is your first post. Edit or delete it, then start writing! This is an example page.",
    "This is a paragraph. Use this area to describe your project, add details or replace this paragraph with your own text. Write a few sentences about your business or project. Add another paragraph or remove it if you need more room or space.",
    "Coming soon. This page is under construction. This page intentionally left blank. Content to be added. To be determined. To be announced. Work in progress. Check back later.",
    "The quick brown fox jumps over the lazy dog. asdf qwerty foo bar baz test test test. Testing one two three.",
    "Dies ist ein Typoblindtext. Weit hinten, hinter den Wortbergen, fern der Länder Vokalien und Konsonantien leben die Blindtexte. Hier steht Ihr Text. Platzhaltertext. Beispieltext.",
    "Ceci est un texte de remplissage. Votre texte ici. Texte d'exemple. Este es un texto de relleno. Su texto aquí. Texto de ejemplo.",
)

FORM = (
    "Describe the bug. A clear and concise description of what the bug is. Tell us what happens instead. Actual behaviour. Actual result.",
    "Expected behavior. A clear and concise description of what you expected to happen. Tell us what should happen.",
    "Steps to reproduce the behavior. Go to, click on, scroll down to, see error. How can we reproduce this? Step one. Step two.",
    "Screenshots. If applicable, add screenshots or logs to help explain your problem. Additional context. Add any other context about the problem here. Provide logs here. Paste output here.",
    "Environment. Desktop, smartphone, device, OS, browser, version. Version for example 22. Which version are you using?",
    "Is your feature request related to a problem? Please describe the problem. Describe the solution you'd like. Describe alternatives you've considered.",
    "What does this pull request do? Please include a summary of the change and which issue is fixed. Describe your changes here. Link to the issue. Why is this change needed?",
    "How has this been tested? Please describe the tests that you ran to verify your changes. Manual tests, unit tests, integration tests. Checklist: my code follows the style guidelines of this project.",
    "Project title. One paragraph of project description goes here. A brief description. Add a short description of the model or table here.",
    "Column name, type, meaning. Name, type, description. column type xxx. Field, type, description. Key, value.",
    "No response. Not applicable. None. N/A. To do. To be completed. Fill in later. TODO write this section. TODO: write an introduction. TBD. Add owner here.",
    "Click or tap here to enter text. Enter your name. Insert name here. Insert date here. Choose an item. Type here. Author name. Company name. Your name.",
    "Dear Sir or Madam. Enter subject. Enter recipient name. Street address. City. Sincerely, your name.",
    "Klicken oder tippen Sie hier, um Text einzugeben. Bitte hier eintragen. Hier Text oder Beschreibung einfügen. Neuer Titel, Name, Datum. Spalten, Ansprechpartner. Noch auszufüllen.",
    "Cliquez ou appuyez ici pour entrer du texte. Insérer le texte ici. Décrivez ici le contenu ou le modèle. Titre. À compléter. Nom, date, colonnes, contact.",
    "Haga clic o pulse aquí para escribir texto. Insertar texto aquí. Describa aquí el contenido o el modelo. Título. Por completar. Nombre, fecha, columnas, contacto.",
)

UNFILLED = (
    "‹mark›", "‹blank›", "‹blank› ‹blank› ‹null›", "‹mark› ‹blank› ‹null› ‹todo›",
    "‹null› ‹null›", "‹todo› ‹todo›", "‹null› ‹todo›",
)

FRAME = (
    "Home Start Menu Search Help Docs Documentation Models Runs Settings Overview Pricing Blog About Contact Sign in Log in Sign out Sign up Register",
    "Back to top. Skip to content. Skip to main content. Toggle navigation. On this page. Table of contents. Breadcrumb. Edit this page. Previous. Next. Print. Share. Ctrl K. Guides. Reference. Community. Support. Release notes. Changelog. Language. English. Light theme. Dark theme.",
    "All rights reserved. Copyright. Imprint. Privacy policy. Terms of service. Cookie settings. Legal notice. Accessibility. Sitemap. Impressum. Datenschutz. Mentions légales. Aviso legal.",
    "Last updated. Last built. Last modified. Generated on. Powered by. Built with. Status: all systems normal. All systems operational.",
)

EXEMPLARS: tuple[tuple[str, str], ...] = tuple(
    (label, text) for label, texts in (("error", ERROR), ("script", SCRIPT), ("filler", FILLER), ("form", FORM), ("unfilled", UNFILLED), ("frame", FRAME)) for text in texts
)
