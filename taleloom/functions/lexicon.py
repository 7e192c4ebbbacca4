"""Word lists, thresholds and patterns that results depend on.

They are stated as plain text because any other value gives other results.
All words are in normalized form (lower case, no accents).
"""

from __future__ import annotations

# Kinship words (pt, en, es).
KINSHIP = (
    "mae mamae pai papai avo avos vovo vo irma irmao irmas irmaos tia tio tias tios filha filho filhas filhos "
    "neta neto netas netos marido esposa esposo mulher sogra sogro cunhada cunhado prima primo madrinha padrinho "
    "afilhada afilhado bisavo "
    "mother mom mum father dad grandmother grandma granny grandfather grandpa sister brother aunt uncle daughter son "
    "granddaughter grandson husband wife cousin godmother godfather "
    "madre mama padre papa abuela abuelo hermana hermano hija hijo nieta nieto cunado cunada suegra suegro madrina padrino"
).split()

# Articles and titles dropped in front of a name.
LEADING_WORDS = "o a os as seu sr sra dona dom the el la los las meu minha mr mrs ms".split()

# First-person possessives.
FIRST_PERSON = "meu minha meus minhas nosso nossa nossos nossas my our mi mis nuestro nuestra nuestros nuestras".split()

# The only words allowed between a possessive and its kinship word.
POSSESSIVE_BRIDGE = "a o the la el".split()

# Words that never make a name by themselves.
LINKING_WORDS = "de da do das dos e del y of di du".split()

# Words that open the name of an institution (pt, es, en).
INSTITUTIONS = (
    "colegio escola grupo faculdade universidade instituto liceu ginasio seminario creche academia conservatorio "
    "igreja capela paroquia catedral basilica convento mosteiro santuario sinagoga mesquita irmandade congregacao "
    "hospital clinica maternidade sanatorio farmacia drogaria posto "
    "banco fabrica usina empresa companhia firma loja mercado supermercado mercearia armazem padaria acougue bar botequim "
    "restaurante lanchonete hotel pensao pousada oficina grafica editora livraria cooperativa cinema teatro radio jornal revista "
    "estaleiro construtora tecelagem prefeitura assembleia ministerio secretaria tribunal forum cartorio delegacia "
    "policia exercito marinha aeronautica quartel batalhao correios sindicato associacao clube federacao partido fundacao "
    "orfanato asilo museu biblioteca "
    "escuela facultad universidad liceo guarderia iglesia capilla parroquia monasterio mezquita cofradia hermandad "
    "compania tienda almacen panaderia carniceria taberna cantina cafeteria pension hostal taller imprenta editorial libreria "
    "cine periodico diario ayuntamiento alcaldia municipalidad gobierno juzgado comisaria ejercito armada cuartel regimiento "
    "correos asociacion club federacion fundacion museo "
    "school college university institute seminary nursery kindergarten church chapel cathedral parish convent monastery "
    "priory synagogue mosque clinic infirmary sanatorium pharmacy bank factory company corporation shop store market "
    "supermarket bakery pub tavern restaurant cafe garage bookshop brewery theatre theater newspaper shipyard colliery "
    "council parliament ministry department government police army navy barracks union association society federation "
    "party foundation orphanage museum library"
).split()

# Words that name a stage of life.
STAGE_WORDS = {
    "crianca": "childhood",
    "menina": "childhood",
    "menino": "childhood",
    "pequena": "childhood",
    "pequeno": "childhood",
    "pequenininha": "childhood",
    "pequenininho": "childhood",
    "garotinha": "childhood",
    "garotinho": "childhood",
    "nenem": "childhood",
    "bebe": "childhood",
    "infancia": "childhood",
    "meninice": "childhood",
    "child": "childhood",
    "kid": "childhood",
    "baby": "childhood",
    "toddler": "childhood",
    "little girl": "childhood",
    "little boy": "childhood",
    "childhood": "childhood",
    "nina": "childhood",
    "nino": "childhood",
    "ninez": "childhood",
    "chiquita": "childhood",
    "chiquito": "childhood",
    "mocinha": "youth",
    "mocinho": "youth",
    "moca": "youth",
    "rapaz": "youth",
    "rapazinho": "youth",
    "jovem": "youth",
    "adolescente": "youth",
    "adolescencia": "youth",
    "juventude": "youth",
    "mocidade": "youth",
    "teenager": "youth",
    "teen": "youth",
    "teens": "youth",
    "teenage years": "youth",
    "adolescent": "youth",
    "adolescence": "youth",
    "youth": "youth",
    "young woman": "youth",
    "young man": "youth",
    "muchacha": "youth",
    "muchacho": "youth",
    "jovencita": "youth",
    "jovencito": "youth",
    "joven": "youth",
    "juventud": "youth",
    "adulta": "adulthood",
    "adulto": "adulthood",
    "idade adulta": "adulthood",
    "mulher feita": "adulthood",
    "homem feito": "adulthood",
    "adult": "adulthood",
    "adulthood": "adulthood",
    "grown up": "adulthood",
    "grown woman": "adulthood",
    "grown man": "adulthood",
    "velha": "later_life",
    "velho": "later_life",
    "idosa": "later_life",
    "idoso": "later_life",
    "velhinha": "later_life",
    "velhinho": "later_life",
    "velhice": "later_life",
    "terceira idade": "later_life",
    "elderly": "later_life",
    "old woman": "later_life",
    "old man": "later_life",
    "old age": "later_life",
    "vieja": "later_life",
    "viejo": "later_life",
    "anciana": "later_life",
    "anciano": "later_life",
    "vejez": "later_life",
}

# First and last age of each stage, for dating and for the axis of a life.
STAGE_AGES = {"childhood": (0, 12), "youth": (13, 25), "adulthood": (26, 59), "later_life": (60, 95)}
AXIS_LAST_AGE = 110

# Number words.
UNITS = {
    "zero": 0, "um": 1, "uma": 1, "dois": 2, "duas": 2, "tres": 3, "quatro": 4, "cinco": 5, "seis": 6, "sete": 7,
    "oito": 8, "nove": 9, "dez": 10, "onze": 11, "doze": 12, "treze": 13, "quatorze": 14, "catorze": 14, "quinze": 15,
    "dezesseis": 16, "dezasseis": 16, "dezessete": 17, "dezassete": 17, "dezoito": 18, "dezenove": 19, "dezanove": 19,
    "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10,
    "eleven": 11, "twelve": 12, "thirteen": 13, "fourteen": 14, "fifteen": 15, "sixteen": 16, "seventeen": 17,
    "eighteen": 18, "nineteen": 19,
    "un": 1, "uno": 1, "dos": 2, "cuatro": 4, "siete": 7, "ocho": 8, "nueve": 9, "diez": 10, "once": 11, "doce": 12,
    "trece": 13, "catorce": 14, "quince": 15, "dieciseis": 16, "diecisiete": 17, "dieciocho": 18, "diecinueve": 19,
    "veintiuno": 21, "veintiun": 21, "veintidos": 22, "veintitres": 23, "veinticuatro": 24, "veinticinco": 25,
    "veintiseis": 26, "veintisiete": 27, "veintiocho": 28, "veintinueve": 29,
}
TENS = {
    "vinte": 20, "trinta": 30, "quarenta": 40, "cinquenta": 50, "cincoenta": 50, "sessenta": 60, "setenta": 70,
    "oitenta": 80, "noventa": 90,
    "twenty": 20, "thirty": 30, "forty": 40, "fifty": 50, "sixty": 60, "seventy": 70, "eighty": 80, "ninety": 90,
    "veinte": 20, "treinta": 30, "cuarenta": 40, "cincuenta": 50, "sesenta": 60, "ochenta": 80,
}
NUMBER_CONNECTORS = "e y and".split()
DURATION_WORDS = "ano anos year years anitos meses mes months dias days".split()

# Markers of an approximate year, and words allowed between marker and year.
APPROXIMATE_MARKERS = [
    "por volta de", "por volta", "la pelos", "la pelo", "la por", "mais ou menos", "perto de", "cerca de",
    "aproximadamente", "around", "about", "circa", "roughly", "approximately", "alrededor de", "hacia", "mas o menos",
]
APPROXIMATE_LINKS = "de em in o del el ano year the do dos anos".split()

# Phrases a speech recognizer invents over silence.
HALLUCINATIONS = [
    "legendas pela comunidade amara org", "legenda pela comunidade amara org", "subtitles by the amara org community",
    "obrigado por assistir", "obrigada por assistir", "inscreva se no canal", "thank you for watching",
    "thanks for watching", "gracias por ver", "transcricao e legendas", "musica", "aplausos",
]
HALLUCINATION_SLACK = 12

# Words ignored in a search question.
STOPWORDS = (
    "a o as os um uma uns umas de da do das dos em na no nas nos num numa por pelo pela para pra pro com sem que quando "
    "como onde qual quais quem ela ele elas eles sua seu suas seus dela dele sobre foi era eram ser ter tinha tinham isso "
    "essa esse esta este aquela aquele aquilo mais muito ja tambem e ou mas se me te lhe voces voce eu minha meu historia "
    "historias contou contava conta contar falou falava fala falar lembra lembrava "
    "the an of in on at to for with about when how where what who she he her his they their them did does was were is "
    "are be been story stories tell told talk talked talking say said from that this it its there any some remember "
    "remembered "
    "el la los las un del en con cuando donde su sus fue conto"
).split()

# Closed list of themes, stages of work and kinds.
THEMES = (
    "childhood family love home work moving hardship celebration food faith school friendship loss travel music land"
).split()
WORK_STAGES = "preserving transcribing organizing indexing ready".split()
PROVENANCE_RANK = {"said": 0, "extracted": 1, "inferred": 2}

# File extension per media type.
MEDIA_EXTENSIONS = {
    "audio/webm": "webm", "audio/ogg": "ogg", "audio/mp4": "m4a", "audio/x-m4a": "m4a", "audio/m4a": "m4a",
    "audio/aac": "aac", "audio/mpeg": "mp3", "audio/mp3": "mp3", "audio/wav": "wav", "audio/x-wav": "wav",
    "audio/wave": "wav", "audio/flac": "flac", "audio/amr": "amr", "audio/3gpp": "3gp", "video/mp4": "mp4",
    "video/webm": "webm",
}

# Thresholds.
SENTENCE_PAUSE, SENTENCE_SHORT_PAUSE, SENTENCE_WORDS = 1.2, 0.6, 45
STORY_SECONDS, STORY_GAP_SEGMENTS, STORY_GAP_SECONDS, RETRY_SECONDS = 8.0, 3, 25.0, 12.0
QUOTE_WORDS = (4, 6, 30)
CHUNK_SECONDS, CHUNK_WORDS = 28.0, 90
PARAGRAPH_GAP, PARAGRAPH_SENTENCES, PARAGRAPH_WORDS = 1.8, 4, 70
PROMPT_TOKENS, TOKENS_PER_LINE = 7000, 6
UNCERTAIN_WORD = 0.4
FRAMES_PER_SECOND = 20
SAME_MOMENT = 1.5
COS_STRONG, COS_WEAK, COS_SPREAD, COS_SEPARATION = 0.42, 0.30, 0.06, 0.08
HEARD_STEPS = 48

# Fixed value: a question is cut to this many characters.
QUESTION_CHARS = 200
