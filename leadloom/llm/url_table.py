"""The labelled URL table: hosts and paths of both labels, put together from word lists written by hand.

No host name, prefix or domain was taken from the data the filter is run on.
Unwanted: a host of unwanted words with any path, or any host with an unwanted
path. Wanted: ordinary hosts (invented ones, well-known ones, and ones that
only contain an unwanted word by chance) with ordinary paths. Both labels have
the same prefixes, endings, added words and ordinary paths, so these carry
little weight.
"""

from __future__ import annotations

from zlib import crc32

UNWANTED = (
    "casino poker slots roulette blackjack betting bets bookie jackpot lottery gambling viagra cialis pills meds pharmacy "
    "steroids tramadol porn xxx sex adult cams escorts nude hentai erotic payday loans cash prize giveaway spam ads adserver "
    "adclick banner popup tracker tracking warez crack keygen torrent replica").split()
ADDED = ("best cheap free online top win fast bonus shop sale farm big hot easy lucky mega super club zone deal box hub live "
         "world king city my the x 24 365").split()
WANTED = (
    "library museum garden history science school recipe travel mineral orchard railway island statue mentor nation attire "
    "lyric shelter anthem weather river mountain kitchen bakery bicycle camera music theatre cinema football cricket tennis "
    "hospital doctor dentist lawyer council village harbour airport hotel bridge castle forest farm field ocean planet rocket "
    "engine motor tractor furniture carpet window builder plumber electric energy water paper printer software database "
    "network server compiler kernel python letter journal gazette herald tribune chronicle observer radio station channel "
    "painter gallery sculpture poetry novel author reader teacher student college academy institute research physics "
    "chemistry biology geology medicine nursing pension insurance account savings market grocer butcher coffee tea wine "
    "cheese bread apple cherry lemon potato pepper salt spice fabric cotton wool leather shoe hat jewel clock watch lamp "
    "candle toy puzzle chess dance yoga running swimming sailing fishing hiking climbing camping horse cattle sheep bird "
    "insect flower tree stone sand metal glass wood wetter rathaus verein zeitung schule bahn stadt buch haus garten mairie "
    "ecole maison jardin livre cuisine voyage musique ciudad escuela libro cocina tienda viaje noticias jornada "
    "post postcard postfix progress grass green great grey sequel square squirrel equal quality question quiet report resort "
    "rescue result sugar summer winter autumn spring monday sunday morning evening night light bright right height weight "
    "language landscape island england holland poland lang slang scale scalar scan scope score school scout open opera operator "
    "opinion option orange order organ origin street stream strength string structure studio study style subject system table "
    "target task taste team tech temple term terrace text theme theory thermal thing thread thunder ticket tide timber time "
    "title token tool topic torch tower town trade trail train treasure trend trial tribe trip truck trust truth tunnel turtle "
    "union unit universe urban value valley vector vehicle vessel victory video view village violin vision visit voice volume "
    "wave web week whale wheat wheel whistle white width wild wing wire wisdom wolf wonder world wrist year yellow young zebra "
    "block blood blue board boat body bone border bottle bottom brain branch brick brother brown brush bucket budget build "
    "cabin cable calm canal canvas capital carbon card care cargo case cause cell central century chain chair chance change "
    "chart child choice church circle citizen city civic claim class clean clear cliff climate cloud club coast code coin cold").split()
#: Well-known sites, and names that hold an unwanted word by chance.
KNOWN = (
    "wikipedia.org mozilla.org python.org apache.org kernel.org debian.org gnu.org w3.org ietf.org archive.org nasa.gov "
    "who.int un.org europa.eu gov.uk nhs.uk service-public.fr bund.de lemonde.fr spiegel.de elpais.com nytimes.com "
    "theguardian.com reuters.com nature.com sciencemag.org arxiv.org acm.org ieee.org mit.edu stanford.edu ox.ac.uk "
    "cam.ac.uk ethz.ch cern.ch stackoverflow.com gitlab.com sourceforge.net mysql.com sqlite.org mongodb.com redis.io nginx.org "
    "docker.com ubuntu.com redhat.com microsoft.com apple.com google.com amazon.com ibm.com intel.com oracle.com sap.com siemens.com "
    "bosch.de renault.fr airbus.com ikea.com lego.com zeit.de heise.de golem.de orf.at srf.ch rtve.es rai.it nrk.no svt.se "
    "yle.fi dr.dk npr.org pbs.org cnn.com imdb.com spotify.com openlibrary.org gutenberg.org wikidata.org creativecommons.org "
    "eff.org essexcouncil.org sussexcricket.co.uk middlesexhospital.org alphabet.xyz betterhomes.com adsorption-society.org "
    "cashmerewool.com cracklingfire.net tabletsupport.com roadshow.tv threads.net downloadsupport.org loansharkhistory.org "
    "essexrailway.co.uk betweenbooks.com diabetes.org.uk tibetmuseum.org beadshop.com heads.org.uk camshaft.de medsci.org "
    "pillsburybakery.com trackandfield.org abc.net.au cbc.ca nbc.com itv.com ard.de zdf.de arte.tv nos.nl vrt.be rte.ie "
    "dw.com ft.com bmj.com php.net qt.io vim.org r-project.org llvm.org ruby-lang.org rust-lang.org go.dev").split()
PREFIXES = ("", "www.", "m.", "blog.", "news.", "shop.", "en.", "static.")
ENDS = ".com .net .org .info .biz .de .fr .es .co.uk .io .eu .se .it .us .ch .nl .example .test".split()
PATHS = (
    "/ /index.html /news /news/world/48211 /about /about-us.html /contact /en/ /de/kontakt /fr/accueil /es/inicio /en/{n} /fr/{n} "
    "/de/{n} /es/{n} /en/{n}.html /{n} /{n}/ /p/{n} /blog/{n} /blog/how-to-bake-bread /wiki/Main_Page /wiki/History_of_science "
    "/docs/ /docs/install.html /docs/{n}/ /download /search /article/{n} /articles/{n}/garden-in-spring /category/books "
    "/category/travel /products/{n} /product/wool-hat /events/2021/05 /2019/03/{n}/ /user/{n}/profile /login /help /faq.html "
    "/sport/football/results /weather/today /recipes/apple-cake /library/catalogue /research/papers/{n}.pdf /jobs /press /team "
    "/privacy /terms /map /images/{n}.png /static/main.css /forum/thread/{n} /questions/{n} /courses/physics-101 /x /a/b/c "
    "/postgres/postgres /health/pharmacy-opening-hours /learning/adult-education /savings/cash-account /loans/book-loans").split()
WRITTEN_PATHS = (
    "/casino-bonus/{n} /online-casino.html /en/free-slots /poker/win-big /play-roulette-now /betting-tips/{n} /free-bets/ "
    "/jackpot-winner /lottery-win/{n} /buy-viagra.html /cheap-viagra-online /cialis-no-prescription /pills/buy-cheap-{n} "
    "/cheap-meds/ /online-pharmacy-sale /steroids-shop /free-porn/{n} /porn-videos /xxx/{n} /xxx-movies.html /sex-cams/live "
    "/adult-videos/{n} /nude-photos /escorts/{n} /hot-sex/{n} /payday-loans-fast /easy-cash-loan/{n} /claim-your-prize "
    "/free-giveaway-prize/{n} /win-iphone-prize /spam/{n} /spam-links.html /ads/click/{n} /adclick?id /popup/ads/{n} /banner-ads/{n} "
    "/ad-tracker/{n} /tracking/click/{n} /warez/{n} /full-crack-keygen /crack-download/{n} /replica-watches-sale "
    "/gambling-bonus /blackjack-online /slots/spin-{n} /viagra/{n} /en/casino/{n} /fr/casino-en-ligne /de/sexkontakte "
    "/es/apuestas-casino /hentai/{n} /erotic/{n}").split()
UNWANTED_PATHS = tuple([*WRITTEN_PATHS, *(
    form.format(word=word, added=ADDED[(7 * n + 3 * k) % len(ADDED)], n="{n}") for n, word in enumerate(UNWANTED)
    for k, form in enumerate(("/{word}/{n}", "/{added}-{word}", "/en/{word}-{added}.html", "/blog/{added}-{word}/{n}", "/{word}")))])
#: Ordinary paths, and ones with the same added words and forms as the unwanted ones.
PATHS = tuple([*PATHS, *(
    form.format(word=WANTED[n], added=ADDED[(7 * n + 3 * k) % len(ADDED)], n="{n}") for n in range(0, len(WANTED), 9)
    for k, form in enumerate(("/{word}/{n}", "/{added}-{word}", "/en/{word}-{added}.html", "/blog/{added}-{word}/{n}", "/{word}")))])


def unwanted_names() -> list[str]:
    """Each word with some added words before or behind it, with or without a hyphen, and with two other unwanted words."""
    out = []
    for n, word in enumerate(UNWANTED):
        for k in range(8):
            added, dash = ADDED[(5 * n + 7 * k) % len(ADDED)], "-" if k % 4 < 3 else ""
            out.append(f"{added}{dash}{word}" if k % 2 else f"{word}{dash}{added}")
        out += [f"{word}-{UNWANTED[(n + k) % len(UNWANTED)]}" for k in (11, 17)]
    return list(dict.fromkeys([*out, "adult-cams", "cheap-meds", "link-farm", "click-farm", "seo-links", "link-spam"]))


def wanted_names() -> list[str]:
    """Each word alone, with added words as the unwanted ones have, and with another wanted word."""
    out = []
    for n, word in enumerate(WANTED):
        a, b, c = (ADDED[(5 * n + 7 * k) % len(ADDED)] for k in range(3))
        other = WANTED[(n * 13 + 29) % len(WANTED)]
        out += [word, f"{word}-{a}", f"{b}-{word}", f"{c}{word}", f"{word}{other}", f"{word}-{other}"]
    return list(dict.fromkeys(out))


def rows(names: list[str], paths: tuple[str, ...], label: int, each: int) -> list[tuple[str, str, str, int]]:
    """(url, name, path pattern, label): every name with ``each`` prefixes, endings and paths, chosen by hashes.

    A name with a dot is a whole domain and gets no ending.
    """
    out = []
    for name in names:
        for k in range(each):
            prefix, end, path, n = (crc32(f"{kind}{k}{label}{name}".encode()) for kind in ("prefix", "end", "path", "number"))
            path = paths[path % len(paths)]
            host = PREFIXES[prefix % len(PREFIXES)] + name + ("" if "." in name else ENDS[end % len(ENDS)])
            out.append((f"https://{host}{path.format(n=n % 10000)}", name, path, label))
    return out


def labelled() -> list[tuple[str, str, str, int]]:
    wanted = wanted_names()
    return (rows(unwanted_names(), PATHS, 1, 4) + rows([*wanted[::6], *KNOWN], UNWANTED_PATHS, 1, 3)
            + rows(wanted, PATHS, 0, 2) + rows(KNOWN, PATHS, 0, 6))
