"""Sentences labelled by construction, from which the model of personal information learns.

A template is a sentence of one of four languages with slots. ``f`` stands for a few
words of any sort, so that what counts is learnt from many surroundings. A slot in capitals is filled by a
seeded generator of made-up values; what it makes is an item of the slot's kind or, for the slots of
:data:`PLAIN`, no item. ``R`` repeats the last number of the document, ``B`` the last surname after
a title, ``V`` a misspelt repeat of it - so that documents hold the same thing in a telling and in a
silent place. Documents are a few sentences in a random order. Nothing here is taken from a corpus.
"""

from __future__ import annotations

import random
import re

#: What a slot's text is; all others are no items.
KIND = {"N": "name", "T": "name", "U": "name", "B": "name", "V": "name", "P": "phone", "I": "id_number", "E": "email", "A": "address"}
PLAIN = ("L", "D", "W")

# Words that announce a number of each sort, put before it in the templates.
ID_WORDS = {
    "en": "passport|passport no.|insurance number|national identity number|identity card|patient record|medical record|social security number|ORCID|driving licence|personal number|patient ID|tax number of the donor|NHS number|health card",
    "de": "Reisepass|Passnummer|Ausweisnummer|Personalausweis|Versichertennummer|Sozialversicherungsnummer|Patientenakte|Krankenversicherung Nr.|Steuernummer",
    "fr": "passeport|numéro d'identité|carte d'identité|numéro de sécurité sociale|dossier du patient|numéro d'assuré",
    "es": "pasaporte|documento de identidad|DNI|NIF|NIE|número de afiliación|historia clínica|expediente del paciente",
}
PHONE_WORDS = {
    "en": "phone|tel.|telephone|call|fax|mobile|cell|hotline|reach us at|dial|ring",
    "de": "Tel.|Telefon|Telefonisch erreichbar unter|Handy|Fax|Rufnummer|Durchwahl|anrufen unter",
    "fr": "tél.|Tél. :|téléphone|portable|appeler le|joindre au|fax",
    "es": "tel.|teléfono|Teléfono de contacto:|móvil|llame al|fax",
}
OTHER_WORDS = {
    "en": "grant no.|lot|catalogue number|version|accession|clone|ISSN|ISBN|batch|serial number|model|order no.|run|build|protocol|trial registration|article|dataset|sample series|part number|receipt",
    "de": "Charge|Bestellnummer|Version|Zugangsnummer|Förderkennzeichen|Seriennummer|Katalognummer|Lauf",
    "fr": "lot|version|numéro de catalogue|subvention no|numéro de série|essai",
    "es": "lote|versión|número de catálogo|ayuda n.º|número de serie|ensayo",
}

TEMPLATES = {
    "en": """Please write to T ( E ) or i P .
Contact: T , A ; phone P .
o L was used, and o D came later.
The i I was stored with the scan.
i I belongs to T .
o L expired last year.
The interview with N , i I , was held in spring.
Participant T ( i I ) left the study.
We thank N and B for help with the samples.
The consent form of T , living at A , carries the number I .
Fax P ; post to A .
Home visits took place at A .
Queries about the code: E
Data were signed by T , i I .
Signed: N
Correspondence: N , E .
u P before noon.
N can be reached at P or E .
The W was described in W .
In W the values of W were lower.
The run of D lasted long.
Samples came from the W and the W .
See o L of the W .
Author ORCID: I .
Later R was checked again.
The entry R was found twice.
A note on R is missing.
It was B who asked for the data.
Mr V signed the second form.
As U noted, the W is slow.
Reviewed by T .
According to the W , o D holds.
Call P or visit A .
Send forms to A .
The number of cases was D in all.
Table 4 lists o L and o L .""",
    "de": """Ansprechpartner ist T , A , i P .
Rückfragen bitte an E oder an N .
i I wurde gelöscht.
Die i I steht im Protokoll.
u P .
o L wurde benutzt.
Im Lauf vom D war der Wert niedrig.
Wir danken N und B für die Hilfe.
Die Proben wurden von T in A genommen.
Später wurde R erneut geprüft.
Der W wurde mit dem W verglichen.
Das W und die W sind bekannt.
Unterschrift: N
Frau V hat zugestimmt.""",
    "fr": """u P , demander T .
Le i I figurait au dossier.
Nous remercions N pour son aide, A .
L'entretien avec N a eu lieu au A .
Contacter T ( E ).
o L a été utilisé.
La mesure du D est perdue.
Plus tard R a été vérifié.
Le W et la W sont connus.
Selon M. V , la mesure est bonne.""",
    "es": """El i I consta en el archivo.
Para consultas, escriba a T , A .
u P .
La muestra fue tomada por N en A .
Agradecemos a N su ayuda, E .
o L se usó en el ensayo.
El ensayo del D falló.
Luego R se revisó otra vez.
El W y la W son conocidos.
La Sra. V firmó la hoja.""",
}
#: Surroundings of any words; used in every language.
OPEN = """f T f .
f T f , T f .
f T f ; N f .
f by T f .
f N f .
f T ( E ) .
f N ( E ) f .
f T , E f .
f by N , E : f .
f N f and N f .
f : T ( i I ) f .
f u P , T .
N f .
T f .
f : T , u P .
f W f .
f W f and W f .
W f .
f W , f .
f L f .
f o L f .
f i I f .
f u P f .
f D f .
f A f .
f E f ."""
FILLERS = (
    "the a this each our these samples were was kept taken read again twice blind before after noon near northern wall table cold in on of with for and scan repeated collected by measured values data access contact team site visit form code letter sent copy first second last week spring winter month "
    "slow fast high low new old model field level rate change group case part end work open closed found seen noted asked held given made used left right during between under over more less than "
    "die der das und im am nahm wurde wurden mit von nach Probe Proben Messung geprüft Wert Woche Kontakt Bericht nicht noch auch sehr kalt "
    "le la les des une dans par avec pour mesure essai froid semaine rapport contact pris lu deux fois après "
    "el los las una en por con para medida ensayo semana informe contacto tomó leyó dos veces después frío"
).split()
TITLES = {"en": "Dr.|Dr|Prof.|Professor|Mr|Mrs.|Ms|Mr.|Mrs|Miss", "de": "Dr.|Frau|Herr|Prof.|Herrn|Frau Dr.|Dr. med.|Prof. Dr.", "fr": "M.|Mme|Dr|Pr|Mlle", "es": "Sr.|Sra.|Dr.|Dra.|Don"}
GIVEN = "Anna Robert Jutta Paule Zoe Helena Thomas Maria Daniel Rebecca Lars Priyanka Giovanni Wei Fatima Ivan Ingrid Kofi Mateo Claire Hans Miriam Oscar Selma Yusuf Astrid Pierre Carmen Dmitri Nora Samuel Judith Victor Emma Paul Edith".split()
SURNAMES = "Vexelmann Ostrander Quillan Lorand Kerner Virand Marquin Brandt Okafor Lindgren Castell Moreau Petrov Haddad Nakamura Svensson Achterberg Whitfield Delacroix Romero Zimmer Kowalski Ferrand Ibarra Thornbury Vogel Hallqvist Danforth Mercier Quintana Tanaka Oduya".split()
PLACES = "Holby Mirmont Wendlin Ostby Karlin Northam Valmy Estrada Brunn Selwick Tarmont Lindau".split()
STREETS = "Merrow Hazel Linden Upper Mill Station Church Castle Garden Harbour Victoria".split()
THINGS = (
    "Monte Carlo|Surface Science|Applied Optics|Upper Valley|Central Registry|Data Archive|Vogel Institute|Lindgren University|Brandt method|Kerner syndrome|Petrov equation|Moreau Foundation|Castell law|North Station|Gold Standard|"
    "Hardy Constant|Deep Sea|Mean Value|Phase Two|Open Access|Northam Hospital|Zimmer model|Quillan effect|Thornbury cohort|Methods Section|Safety Board|Soft Matter|Ethics Committee|Study Group|Romero distribution|Ostrander test|Tanaka type"
).split("|")


def _digits(r: random.Random, form: str) -> str:
    return re.sub("#", lambda _: str(r.randrange(10)), form)


PHONES = "+44 20 7946 0###|(###) 555-01##|###-555-01## ext. ##|0049 30 23125###|030/23125-###|01632 960###|+33 1 99 00 ## ##|0033 1 9900 ####|999 20 ## ##|+1 (###) 555 01##|###.555.01##|+34 999 20 ## ##|01 99 00 ## ##|###-555-0###|0## / ######|+49 30 23125 ###|##### ######".split("|")
IDS = "000-##-####|######-####|9 85 03 35 ### ### ##|K####/###|XK#######|MRN-####-###|########L|### ### ###|#########|0000-000#-####-####|00########O|###-##-####|##.###.###-#|AB ######|P#######|X#######T|1 85 03 97 ### ### ##".split("|")
OTHERS = "21-####-01|4.12.####|VX######|####-##-####|####-####-#|####-###X|##########|########|##.###.####|KL #####|AX######|######|2.##.####.#|R#-####|########".split("|")
DATES = "20##-03-14|19##/11/02|12.05.20##|12:45:30|1.234.###|########## 00001|# ### ###|20## 2021|10.##### 0###".split("|")


def _any_form(r: random.Random) -> str:
    """A number of any grouping, of nine to twelve digits."""
    groups = r.choice(["3-3-4", "3-6", "2-2-2-2-2", "3-3-3", "4-6", "3-4-4", "2-4-4", "5-5", "9", "10", "6-4", "3-2-4"]).split("-")
    return r.choice([" ", "-", " ", "-", ".", "/"]).join("#" * int(g) for g in groups)


class Maker:
    """Fills the slots of one document."""

    def __init__(self, r: random.Random, lang: str):
        self.r, self.lang = r, lang
        self.number, self.surname = "", ""
        self.told = ""  # the slots whose number an announcing word stands before

    def name(self) -> str:
        r = self.r
        given, surname = r.choice(GIVEN), r.choice(SURNAMES)
        self.surname = surname
        return r.choice([f"{given} {surname}", f"{given} {r.choice('ABCDEFGHJKLMRST')}. {surname}", f"{given[0]}. {surname}", f"{given[0]}.{r.choice(['', ' '])}{r.choice('ABEMR')}. {surname}", f"{given[0]}. {r.choice('CDGJMRST')}. {surname}", f"{surname}, {given}", f"{given} {surname}", f"{given} {surname}"])

    def slip(self, word: str) -> str:
        i = self.r.randrange(1, len(word) - 1)
        return self.r.choice([word[:i] + word[i + 1] + word[i] + word[i + 2 :], word[:i] + word[i + 1 :], word[:i] + "aeiortn"[i % 7] + word[i + 1 :]])

    def address(self) -> str:
        r = self.r
        place = r.choice(PLACES)
        return {
            "en": r.choice([f"{r.randrange(1, 300)} {r.choice(STREETS)} {r.choice(['Street', 'Road', 'Lane', 'Rd', 'Ave.', 'Close', 'Court'])}, {place}", f"Flat {r.randrange(1, 30)}, {r.randrange(1, 99)} {r.choice(STREETS)} Street, {place}"]),
            "de": f"{r.choice(STREETS)}{r.choice(['straße', 'weg', 'platz', 'str.'])} {r.randrange(1, 120)}, {r.randrange(10000, 99999)} {place}",
            "fr": f"{r.randrange(1, 200)}{r.choice(['', ' bis', ','])} {r.choice(['rue', 'avenue', 'boulevard'])} {r.choice(['des ', 'de ', ''])}{r.choice(STREETS)}, {r.randrange(10000, 99999)} {place}",
            "es": f"{r.choice(['Calle', 'Avda.', 'Plaza de'])} {r.choice(STREETS)}, {r.randrange(1, 200)}, {place}",
        }[self.lang]

    def fill(self, slot: str) -> str:
        r = self.r
        if slot == "N":
            return self.name()
        if slot == "T":
            return r.choice([self.name(), r.choice(SURNAMES)])
        if slot == "U":
            self.surname = r.choice(SURNAMES)
            return self.surname
        if slot == "B":
            return self.surname or r.choice(SURNAMES)
        if slot == "V":
            return self.slip(self.surname or r.choice(SURNAMES))
        if slot == "A":
            return self.address()
        if slot == "E":
            user = f"{r.choice(GIVEN)}{r.choice(['.', '_', '', '-'])}{r.choice(SURNAMES)}".lower()
            return user + r.choice(["@", "@", " (at) ", " [at] "]) + r.choice(["lab.example", "uni-holby.example", "mail.test"])
        if slot == "W":
            return r.choice(THINGS)
        # Now and then the form tells nothing, so the words before it must.
        form = _any_form(r) if slot in self.told and r.random() < 0.45 else r.choice({"P": PHONES, "I": IDS, "L": OTHERS, "D": DATES}[slot])
        self.number = _digits(r, form)
        return self.number


def document(seed: int) -> tuple[str, list[tuple[int, int, str]]]:
    """(text, [(start, end, kind)]) of a made-up document."""
    r = random.Random(seed)
    lang = r.choice(["en", "en", "de", "fr", "es"])
    maker, text, items = Maker(r, lang), "", []
    kind_of_number = ""
    lines, free = TEMPLATES[lang].splitlines(), OPEN.splitlines()
    for line in [r.choice(free if r.random() < 0.5 else lines) for _ in range(r.randrange(2, 8))]:
        maker.told = "".join(k for k, w in (("I", "i"), ("P", "u"), ("L", "o")) if w in line.split(" "))
        for token in line.split(" "):
            glue = "" if not text or text[-1] in "( \n" or token in (".", ",", ";", ")", ").", ").") else " "
            if token == "f":
                words = " ".join(r.choice(FILLERS) for _ in range(r.randrange(1, 5)))
                text += glue + (words[0].upper() + words[1:] if not text or text[-1] in " \n" and text.rstrip()[-1:] == "." else words)
                continue
            if token in ("i", "o", "u"):
                piece = r.choice({"i": ID_WORDS, "o": OTHER_WORDS, "u": PHONE_WORDS}[token][lang].split("|"))
                if line.startswith("Please") or line.startswith("Ansprech"):
                    piece = r.choice(PHONE_WORDS[lang].split("|"))
                text += glue + (piece[0].upper() + piece[1:] if not glue or text.endswith(".") else piece)
                continue
            if token == "R":
                if not maker.number:
                    text += glue + "it"
                    continue
                piece, kind = maker.number, kind_of_number
            elif token in KIND or token in PLAIN:
                piece, kind = maker.fill(token), KIND.get(token, "none")
                if token in "PILD":
                    kind_of_number = kind
                if token in ("T", "B") and line != "Signed: N":
                    text += glue + r.choice(TITLES[lang].split("|"))
                    glue = " "
                elif token == "U":
                    text += glue + r.choice(TITLES[lang].split("|"))
                    glue = " "
            else:
                text += glue + token
                continue
            text += glue
            items.append((len(text), len(text) + len(piece), kind))
            text += piece
        text += r.choice([" ", " ", "\n", " The samples were stored cold. "])
    return text, [x for x in items if x[2] != "none"]


def documents(n: int, seed: int = 0) -> list[tuple[str, list[tuple[int, int, str]]]]:
    return [document(seed * 1_000_003 + i) for i in range(n)]
