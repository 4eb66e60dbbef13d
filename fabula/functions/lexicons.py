"""Word lists. Fixed values, kept small and general; every operator takes its list as a parameter."""

STOP_WORDS = "el la los las un una unos unas de del al a en con por para sin sobre que y o u e ni no se su sus lo le les me te mi tu es era fue ser ha the of and to in is that it for was with be on as at by this are from or an".split()
GLUE_WORDS = STOP_WORDS + "muy ya como si pero más este esta esto ese esa eso aquel aquella he him her his they them you we not but have had which der die das und ein eine zu von le les des et du est".split()
FILLERS = ("bueno", "pues", "o sea", "es decir", "la verdad", "de hecho", "en plan", "sin más", "en realidad", "al fin y al cabo", "you know", "i mean", "sort of", "kind of", "as it were")
SENSES = {
    "sight": ("luz", "color", "ver", "mira", "brill", "sombra", "look", "see", "light"), "hearing": ("ruido", "voz", "grito", "sonid", "silenci", "hear", "sound", "noise"),
    "touch": ("piel", "frío", "mano", "suave", "áspero", "touch", "cold", "warm"), "smell": ("olor", "aroma", "perfume", "hedor", "smell", "scent"), "taste": ("sabor", "dulce", "amargo", "salado", "taste", "sweet")}
FIRST_PERSON = ("yo", "me", "mi", "mis", "mí", "conmigo", "nosotros", "nosotras", "nos", "nuestro", "nuestra", "i", "my", "we", "our")
SECOND_PERSON = ("tú", "tu", "tus", "te", "ti", "contigo", "usted", "ustedes", "vosotros", "vuestro", "you", "your")
THIRD_PERSON = ("él", "ella", "ellos", "ellas", "su", "sus", "le", "les", "he", "she", "they", "his", "her", "their")
POSITIVE = ("feliz", "alegre", "bien", "amor", "gracias", "genial", "sonri", "happy", "good", "thank", "great", "love")
NEGATIVE = ("triste", "mal", "odio", "miedo", "rabia", "horrible", "llor", "sad", "bad", "hate", "fear", "wrong")
ACTION = ("corrió", "saltó", "golpeó", "gritó", "disparó", "huyó", "atacó", "cayó", "lanzó", "ran", "jumped", "hit", "shouted", "fell", "threw")
REGIONAL = {"coche": "es", "ordenador": "es", "móvil": "es", "zumo": "es", "carro": "mx", "computadora": "mx", "celular": "mx", "jugo": "mx", "pavement": "uk", "lorry": "uk", "flat": "uk", "sidewalk": "us", "truck": "us", "apartment": "us"}
CONFUSED = (("haber", "ver"), ("halla", "haya"), ("echo", "hecho"), ("tubo", "tuvo"), ("valla", "vaya"), ("votar", "botar"), ("their", "there"), ("affect", "effect"))
PERIODS = (("antigüedad", -3000, 476), ("edad media", 476, 1492), ("edad moderna", 1492, 1789), ("siglo xix", 1800, 1900), ("siglo xx", 1900, 2000), ("contemporánea", 1789, 2100))
NUMBER_WORDS = {
    "un": 1, "una": 1, "uno": 1, "dos": 2, "tres": 3, "cuatro": 4, "cinco": 5, "seis": 6, "siete": 7, "ocho": 8, "nueve": 9, "diez": 10, "once": 11, "doce": 12, "trece": 13, "catorce": 14, "quince": 15,
    "veinte": 20, "treinta": 30, "cuarenta": 40, "cincuenta": 50, "cien": 100}
VAGUE_NUMBERS = ("unos", "unas", "algunos", "algunas", "varios", "varias", "pocos", "pocas", "muchos", "muchas")
#: Days of a unit of time; without accents, as units are looked up in plain text.
UNIT_DAYS = {"minuto": 1 / 1440, "hora": 1 / 24, "dia": 1.0, "semana": 7.0, "quincena": 15.0, "mes": 30.0, "ano": 365.0, "decada": 3650.0, "siglo": 36500.0}
EARLIEST_YEAR = {"teléfono": 1876, "televisión": 1927, "internet": 1983, "tren": 1804, "automóvil": 1886, "avión": 1903, "radio": 1895, "ordenador": 1941, "fotografía": 1839, "telégrafo": 1837}
