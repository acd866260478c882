"""Closed word lists, categories and rule constants.

These decide results and are versioned with them; change one, and the frame
version has to change too.
"""

from __future__ import annotations

FEATURES_VERSION = "2.0"
# fixed value: the version that stored panels carry
PANEL_VERSION = "panel-1.0"
FRAME_VERSION = "mm-2026-08-v1"

# --- fixed values: the bilingual phrase lists --------------------------------

CONNECTIVES = {
    "es": ["porque", "por lo tanto", "por eso", "sin embargo", "no obstante", "en cambio", "ademas",
           "por ejemplo", "es decir", "en consecuencia", "aunque", "mientras que", "de hecho", "asi que",
           "dado que", "debido a", "gracias a", "a pesar de", "en realidad", "o sea"],
    "en": ["because", "therefore", "however", "nevertheless", "instead", "for example", "that is",
           "as a result", "although", "while", "in fact", "so that", "due to", "thanks to", "despite",
           "actually"],
}
ATTRIBUTION = {
    "es": ["segun", "de acuerdo con", "un estudio", "una investigacion", "los datos", "la fuente",
           "las fuentes", "informo", "publico", "revelo", "el informe", "la encuesta", "el paper",
           "los expertos", "el investigador", "la investigadora", "la universidad", "citando"],
    "en": ["according to", "a study", "research shows", "the data", "the source", "reported", "published",
           "revealed", "the report", "the survey", "the paper", "experts", "researchers", "the university"],
}
HEDGES = {
    "es": ["quiza", "quizas", "tal vez", "puede que", "probablemente", "parece que", "aproximadamente",
           "en torno a", "mas o menos", "en general", "suele", "podria", "no esta claro", "se estima"],
    "en": ["maybe", "perhaps", "probably", "it seems", "approximately", "around", "roughly", "generally",
           "might", "unclear", "estimated"],
}
ABSOLUTES = {
    "es": ["siempre", "nunca", "jamas", "todos", "nadie", "nada", "obviamente", "claramente", "sin duda",
           "absolutamente", "definitivamente", "el mejor", "el peor", "increible", "brutal", "tremendo"],
    "en": ["always", "never", "everyone", "nobody", "obviously", "clearly", "no doubt", "absolutely",
           "definitely", "the best", "the worst", "incredible", "insane", "crazy"],
}
STRUCTURE = {
    "es": ["en primer lugar", "en segundo lugar", "en tercer lugar", "por ultimo", "para terminar",
           "en resumen", "resumiendo", "vamos a ver", "empecemos por", "por otro lado", "a continuacion",
           "el siguiente punto", "recapitulando", "para cerrar", "en conclusion", "antes que nada",
           "el primer punto", "lo primero que", "lo ultimo que", "para empezar"],
    "en": ["first of all", "secondly", "thirdly", "finally", "to sum up", "in summary", "let's see",
           "let's start", "on the other hand", "next up", "the next point", "to recap", "in conclusion",
           "the first point", "the first thing", "to begin with"],
}
CALLS_TO_ACTION = {
    "es": ["suscrib", "suscribete", "campanita", "dale like", "dejame un like", "un like", "comenta",
           "comentarios", "activa las notificaciones", "link en la descripcion", "enlace en la descripcion",
           "hazte miembro", "miembro del canal", "patreon", "apoya el canal", "compartilo", "compartelo",
           "no te olvides de", "sigueme en"],
    "en": ["subscribe", "hit the bell", "like this video", "leave a like", "comment below",
           "turn on notifications", "link in the description", "become a member", "channel member", "patreon",
           "support the channel", "share this", "don't forget to", "follow me on"],
}
SPONSORSHIP = {
    "es": ["patrocina", "patrocinado", "este video es posible gracias a", "codigo de descuento", "cupon",
           "publicidad", "anunciante", "usa mi codigo", "link de afiliado", "gracias a nuestro"],
    "en": ["sponsor", "sponsored by", "this video is brought to you by", "discount code", "coupon",
           "promo code", "affiliate link", "use my code", "thanks to our"],
}
FILLERS = {
    "es": ["este", "eh", "em", "o sea", "digamos", "viste", "bueno", "nada", "tipo", "obvio", "che"],
    "en": ["um", "uh", "like", "you know", "i mean", "basically", "right"],
}
TEASERS = {
    "es": ["mas adelante", "al final del video", "ya te voy a contar", "espera", "esperen",
           "quedate hasta el final", "en un momento", "ahora vas a ver", "lo mejor viene", "no te vayas"],
    "en": ["later in this video", "at the end of the video", "stay till the end", "in a moment",
           "wait for it", "you'll see", "don't go anywhere"],
}

# indicator key -> phrase lists
LEXICONS = {
    "conectores": CONNECTIVES,
    "atribucion": ATTRIBUTION,
    "matizadores": HEDGES,
    "absolutos": ABSOLUTES,
    "estructura": STRUCTURE,
    "cta": CALLS_TO_ACTION,
    "patrocinio": SPONSORSHIP,
    "muletillas": FILLERS,
    "anticipacion": TEASERS,
}

# --- fixed values: stop words --------------------------------------------------

STOP_WORDS = {
    "es": """de la que el en y a los del se las por un para con no una su al lo como mas pero sus le ya o
             este si porque esta entre cuando muy sin sobre tambien me hasta donde quien desde todo nos
             durante todos uno les ni contra otros ese eso ante ellos e esto mi antes algunos que unos yo
             otro otras otra el tanto esa estos mucho quienes nada muchos cual poco ella estar estas algunas
             algo nosotros mi mis tu te ti tus ellas nosotras vosotros vosotras os mio mia mios mias tuyo
             tuya tuyos tuyas suyo suya suyos suyas nuestro nuestra nuestros nuestras vuestro vuestra
             vuestros vuestras esos esas es son ser fue han hay va vamos asi bien aqui ahi alla entonces
             hace hacer tiene tienen tener puede pueden dice decir dos tres""".split(),
    "en": """the of and to a in is it you that he was for on are with as i his they be at one have this from
             or had by hot but some what there we can out other were all your when up use word how said an
             each she which do their time if will way about many then them would write like so these her
             long make thing see him two has look more day could go come did no most my over know than call
             first who its now find down been made may part""".split(),
}

# words that mark a text as Spanish when no language is declared
SPANISH_MARKERS = """de la que el en y a los se del las un por con no una su para es al lo como mas o pero sus
    le ya este si porque esta entre cuando muy sin sobre tambien me hasta hay donde quien desde todo nos durante
    todos uno les ni contra otros ese eso ante ellos esto antes algunos unos yo otro otras otra tanto esa estos
    mucho quienes nada muchos cual poco ella estar estas algunas algo nosotros vos ustedes""".split()

# --- fixed values: numbers, units, links ---------------------------------------

UNITS = ["km", "kg", "mts", "metros", "kilometros", "kilos", "toneladas", "litros", "euros", "dolares", "pesos",
         "millones", "miles", "billones", "hectareas", "grados", "horas", "minutos", "segundos", "anos",
         "siglos", "habitantes", "miles de millones", "millon", "puntos", "goles"]
NUMBER_WORDS = ["cero", "uno", "una", "dos", "tres", "cuatro", "cinco", "seis", "siete", "ocho", "nueve", "diez",
                "once", "doce", "trece", "catorce", "quince", "veinte", "treinta", "cuarenta", "cincuenta",
                "sesenta", "setenta", "ochenta", "noventa", "cien", "ciento", "mil", "millon", "millones",
                "mitad", "doble", "triple", "tercio", "porcentaje"]

URL_PATTERN = r"""https?://[^\s<>"')]+"""
SOCIAL_HOSTS = ["youtube.com", "youtu.be", "instagram.com", "twitter.com", "x.com", "facebook.com", "tiktok.com",
                "patreon.com", "discord.", "twitch.tv", "open.spotify.com", "linktr.ee", "t.me", "threads.net",
                "linkedin.com/in", "bit.ly"]
TRACEABLE_HOSTS = [".gov", ".edu", ".ac.", ".org", "doi.org", "arxiv.org", "nature.com", "science.org", "pubmed",
                   "ncbi.nlm", "who.int", "un.org", "worldbank", "ine.es", "indec.gob", "eurostat",
                   "scholar.google", "jstor", "springer", "elsevier", "wikipedia.org", "reuters.com",
                   "apnews.com", "bbc.co", "nytimes.com", "elpais.com", "ft.com"]

# --- fixed values: title rules ---------------------------------------------------

PERISHABLE = ["hoy", "ayer", "ultima hora", "en vivo", "directo", "jornada", "fecha", "resumen", "highlights",
              "goles", "vs", "final", "semifinal", "cuartos", "clasificacion", "programa", "episodio", "noticias",
              "breaking", "live", "recap", "matchday", "week", "2020", "2021", "2022", "2023", "2024", "2025",
              "2026"]
SUPERLATIVES = ["increible", "brutal", "impactante", "no vas a creer", "lo que nadie", "la verdad sobre",
                "por fin", "shock", "escandalo", "el mejor", "el peor", "urgente", "insolito", "asi fue",
                "esto cambia todo", "nadie te dice", "shocking", "you won't believe", "the truth about", "insane",
                "gone wrong", "exposed"]
# editorial form: any of these inside title + tags
TALK_WORDS = ["podcast", "entrevista", "episodio", "charla con", "mano a mano"]
RECAP_WORDS = ["resumen", "highlights", "goles", "compacto", "recap", "lo mejor de"]
RANKING_WORDS = ["top ", "ranking", "mejores", "peores"]
LIVE_WORDS = ["en vivo", "directo", "live", "stream"]
EXPLAINER_WORDS = ["analisis", "explicado", "por que", "que paso", "la historia de"]
REVIEW_WORDS = ["review", "reseña", "opinion", "critica", "reacciono", "reaccion"]
HOWTO_PREFIX = r"^\s*(como|how to|tutorial|guia|aprende|paso a paso)"
IMPERATIVE_PREFIX = r"^\s*(como|no |deja|mira|aprende|descubre|how|stop|watch)"

# --- fixed values: categories, strata, panel --------------------------------------

CATEGORY_NAMES = {
    "1": "Film & Animation", "2": "Autos & Vehicles", "10": "Music", "15": "Pets & Animals", "17": "Sports",
    "19": "Travel & Events", "20": "Gaming", "22": "People & Blogs", "23": "Comedy", "24": "Entertainment",
    "25": "News & Politics", "26": "Howto & Style", "27": "Education", "28": "Science & Technology",
    "29": "Nonprofits & Activism",
}
CATEGORY_FORMAT = {
    "25": "informativo", "27": "informativo", "28": "informativo",
    "26": "practico_personal", "22": "practico_personal", "19": "practico_personal", "15": "practico_personal",
    "2": "practico_personal",
    "24": "entretenimiento", "23": "entretenimiento", "1": "entretenimiento", "10": "entretenimiento",
    "17": "deporte_gaming", "20": "deporte_gaming",
}
FORMATS = ["informativo", "practico_personal", "entretenimiento", "deporte_gaming"]
DURATIONS = ["corto", "medio", "largo"]
MIN_SECONDS, SHORT_SECONDS, MEDIUM_SECONDS, MAX_SECONDS = 120, 600, 1800, 10800

PANEL_UNITS = {
    "ritmo_ppm": "palabras/min",
    "cifras_100w": "cifras/100 palabras",
    "atribucion_1000w": "marcas/1000 palabras",
    "mattr_200": "0-1",
    "conectores_1000w": "marcas/1000 palabras",
    "enlaces_externos": "enlaces (absoluto)",
    "promocional_1000w": "marcas/1000 palabras",
    "cobertura_titulo": "0-1",
}
PANEL = list(PANEL_UNITS)

ZERO_SHARE_LIMIT = 1.0 / 3.0
PERMUTATION_ALPHA = 0.05
PERMUTATIONS = 2000

# --- a second list set for prose in which the lists above never occur -------------

STAND_IN_VERSION = "stand-in-1"
STAND_IN_LEXICONS = {
    "conectores": {"es": ["de la", "que", "et la", "und die"], "en": ["of the", "that is", "that"]},
    "atribucion": {"es": ["en la", "le la", "der die"], "en": ["in the", "by the"]},
    "matizadores": {"es": ["une", "el", "das"], "en": ["or", "it"]},
    "absolutos": {"es": ["una", "un", "ist"], "en": ["is", "the is"]},
    "estructura": {"es": ["la de", "de los", "die der"], "en": ["and the", "for the"]},
    "cta": {"es": ["con la", "est la", "mit der"], "en": ["at the", "on the"]},
    "patrocinio": {"es": ["por la", "la le", "ist die"], "en": ["was the", "as the"]},
    "muletillas": {"es": ["y", "et", "und"], "en": ["and"]},
    "anticipacion": {"es": ["se la", "il la", "zu der"], "en": ["with the", "it was"]},
}
