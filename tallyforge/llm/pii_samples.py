"""Labelled sentences for training the finder of personal data: entities put into carrier phrases, and sentences whose
numbers and names are none.

A sentence is a list of (text, label); label '' is no entity.  The number of sentences is ``SENTENCES``.
"""

from __future__ import annotations

import random

SENTENCES = 15000

#: First names of many countries, parts of surnames and streets, and kinds of streets.
FIRST = """Amadou Ana Anselm Anders Andrew Anna Arjun Ayesha Bartek Beatriz Bohdan Brian Callum Carla Carlos Chiara Chloe Claire Clive Daniel David Deepak Diego
Dmitri Edda Elena Emeka Emily Emma Erik Ezra Fatima Felix Fiona Florian Francesca Gabriel George Giulia Greta Gudrun Hamza Hannah Haruto Heidi Helen Henrik Hugo
Ibrahim Ifeoma Ines Ingrid Isolde Ivan James Jarek Jasmin Javier Joaquin John Jonas Julia Kaspar Kate Kenji Kevin Klara Kofi Laura Lars Laszlo Leila Liam Liesl Linda
Lucia Ludwig Luis Maeve Malik Marco Maria Marlene Marta Martin Mateo Mia Michael Mohamed Moritz Nadia Natalie Niamh Nikolai Nina Noor Odile Olga Oliver Omar Orla Oscar
Paloma Patrick Paul Petra Pierre Priya Rachel Rafael Ramiro Rashid Rita Robert Roman Rosa Rowan Ruth Samuel Sandra Sara Saskia Sebastian Simone Sofia Stefan Sunniva Susan
Tamara Tariq Thomas Tobin Tomas Ulrich Ursula Valentina Vera Viggo Viktor Wilma Winifred Torben Desmond Delphine Leopold Oskar Thandi Dagny Astrid Benedikt Camille Dieter Elif Gustav Hilda Jamal Yara Yusuf Zofia Zoe""".split()
STEMS = """Aber Ash Black Brindle Brook Carter Dal Dom Dram Ed Fen Fern Garn Green Hal Hallow Harr Hart Hol Illes Jan Ken Kjel Kowal Lang March Mill Mor Nor Oden Omba Oquen
Pem Petr Prusko Quist Rend Rendle Rich Rock Sand Schul Sokol Stan Stove Sul Tarn Tess Thorn Ulla Vald Varn Wal Wex Whit Wolf Zell""".split()
ENDS = "beck berg brand by combe cote dez er ez field ford gate hall ham ho holt kirk land ley low man mann mere noll oglu ov rane riti sen ski son sson stein thorpe ton vane well wood worth".split()
STREETS = """Acacia Alder Barrow Bell Birch Bridge Canal Castle Cedar Chapel Church Cinder Hill|Copper Barn|Cross Elm Fairfield Ferry Furnace Gosling Green Grove Harbour High Hollow Juniper
Kiln King Lantern Lark Lime Linden Market Mead Mill Race|Nettle Oak Orchard Oxbow Park Pember Pine Plum Quarry Quarrel River Rookery Rose Salt Marsh|Saddler Sexton Station Stone Tanner Thistle
Thorn Union Valley Walnut Weir Wick Willow Wren Yarrow""".replace("\n", " ").split()
KINDS = "Street St St. Road Rd Rd. Avenue Ave Ave. Lane Ln Drive Dr Court Ct Way Blvd Boulevard Close Place Terrace Crescent".split()
TOWNS = "Fen Mar Ostle Grey Vel Dun Port Tam Lang North Brack Ald Hex Wex Cor Silver Stan Kirk Holm Ash".split()
TOWN_ENDS = "bury water mer lathe warren sin ford wick ton ham field stead borough mouth".split()
TITLES = "Mr Mr. Mrs Mrs. Ms Ms. Dr Dr. Prof. Herr Frau Mme Madame Monsieur Sr. Sra. Señor Señora Don".split()
MAIL = "mail inbox post fast box lake ridge shop own kurz barn wire lane home tele net cloud my web".split()
TOP = "example example.org example.net example.com com net org de fr es test co.uk".split()


class Maker:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def digits(self, n: int) -> str:
        return "".join(self.r.choice("0123456789") for _ in range(n))

    def up(self, n: int) -> str:
        return "".join(self.r.choice("ABCDEFGHJKLMNPRSTUVWXYZ") for _ in range(n))

    def surname(self) -> str:
        if self.r.random() < 0.25:  # of no known parts
            return "".join(self.r.choice("b c d f g h j k l m n p r s t v w z br tr kl st sch".split()) + self.r.choice("aeiou") for _ in range(self.r.choice([2, 3]))).capitalize() + self.r.choice(["", "n", "r", "l", "s", "ck"])
        return self.r.choice(STEMS) + self.r.choice(ENDS)

    def first(self) -> str:
        if self.r.random() < 0.25:  # in no list
            return "".join(self.r.choice("b d f g h j k l m n p r s t v y z th ch".split()) + self.r.choice("aeiou") for _ in range(self.r.choice([2, 2, 3]))).capitalize() + self.r.choice(["", "", "n", "s", "l"])
        return self.r.choice(FIRST)

    def name(self) -> str:
        r, f, s = self.r, self.first(), self.surname()
        n = r.choices([f"{f} {s}", f"{f[0]}. {s}", f"{f} {self.up(1)}. {s}", f"{r.choice(TITLES)} {s}", f"{r.choice(TITLES)} {f} {s}", f"{s}, {f}", f"{f[0]}.{self.up(1)}. {s}"], [9, 3, 2, 5, 3, 3, 0.5])[0]
        return self.case(n, 0.27, 0.1)

    def case(self, t: str, lower: float, upper: float) -> str:
        x = self.r.random()
        return t.lower() if x < lower else t.upper() if x < lower + upper else t

    def email(self) -> str:
        r, f, s = self.r, self.r.choice(FIRST).lower(), self.surname().lower()
        local = r.choice([f"{f}.{s}", f"{f}_{s[:4]}", f"{f[0]}{s}", f"{s}{self.digits(2)}", f"{f}+parts", f"{s}-{f}", f"{f}{self.digits(4)}", f"{f}.{s}{self.digits(1)}", f"info.{s}"])
        dom = f"{r.choice(MAIL)}{r.choice(['', '.'])}{r.choice(MAIL)}.{r.choice(TOP)}"
        at, dot = r.choices([("@", "."), (" (at) ", " (dot) "), ("[at]", "[dot]"), (" AT ", " DOT "), (" @ ", "."), (" at ", " dot "), ("(at)", ".")], [10, 2, 2, 2, 1, 1, 1])[0]
        return self.case(local + at + dom.replace(".", dot), 0, 0.15)

    def phone(self) -> str:
        r, d = self.r, self.digits
        if r.random() < 0.15:
            return r.choice(["1" + d(10), d(10), d(11)])
        return r.choice([
            f"{d(3)}-{d(3)}-{d(4)}", f"({d(3)}) {d(3)}-{d(4)}", f"1{d(10)}", d(11), f"{d(3)}.{d(3)}.{d(4)}", f"{d(3)} {d(3)} {d(4)}", f"{d(3)}/{d(3)}-{d(4)} ext. {d(2)}", f"{d(3)}-{d(3)}-{d(4)} x{d(3)}", f"+1 {d(3)} {d(3)} {d(4)}", f"1{d(10)}", f"+1-{d(3)}-{d(3)}-{d(4)}",
            f"+44 {d(4)} {d(6)}", f"0{d(4)} {d(3)} {d(3)}", f"0{d(4)} {d(6)}", f"+49 {d(2)} {d(5)} {d(3)}", f"+49 {d(3)} {d(7)}", f"0{d(3)} {d(6)}", f"+33 {d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", f"0{d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", f"+34 {d(3)} {d(3)} {d(3)}",
            f"{d(3)}-{d(4)}", " ".join(d(3)) + " - " + " ".join(d(4)), " ".join(d(3)) + " - " + " ".join(d(3)) + " - " + " ".join(d(4)), f"+{d(2)}{d(10)}", f"{d(10)}", f"(0{d(2)}) {d(7)}"])

    def id_number(self) -> tuple[str, str]:
        """The words before it, and the number."""
        r, d, u = self.r, self.digits, self.up
        if r.random() < 0.5:  # any paper with any number
            n = r.choice([u(r.randint(1, 3)) + d(r.randint(5, 8)), u(1) + d(2) + u(1) + d(5), d(r.randint(8, 11)), d(8) + u(1), f"{d(3)}-{d(2)}-{d(4)}", f"{u(1)}{d(3)}-{d(4)}-{d(4)}", f"{d(2)} {d(2)} {d(2)} {d(3)}", u(2) + d(6) + u(1), f"{d(3)} {d(3)} {d(3)}", d(2) + u(2) + d(5)])
            return r.choice(PAPERS) + r.choice([" ", " ", " ", ": ", " is ", " no. ", " # "]), n
        return r.choice([
            ("SSN ", f"{d(3)}-{d(2)}-{d(4)}"), ("my social is ", f"{d(3)}-{d(2)}-{d(4)}"), ("social ", f"{d(3)}-{d(2)}-{d(4)}"), ("social security number ", d(9)), ("social security number ", f"{d(3)}-{d(2)}-{d(4)}"), ("social security no. ", f"{d(3)} {d(2)} {d(4)}"),
            ("tax id ", f"{d(3)}-{d(2)}-{d(4)}"), ("tax ID: ", d(11)), ("passport ", f"{u(2)}{d(7)}"), ("passport no. ", d(9)), ("passport number ", f"{u(1)}{d(8)}"), ("Reisepass ", f"C{d(2)}{u(2)}{d(4)}"), ("passeport ", f"{d(2)}{u(2)}{d(5)}"), ("pasaporte ", f"{u(3)}{d(6)}"),
            ("driver's licence ", f"{u(1)}{d(3)}-{d(4)}-{d(4)}"), ("driver's license ", f"{u(1)}{d(7)}"), ("DL# ", f"{u(1)}{d(7)}"), ("licence number ", f"{u(5)}{d(6)}{u(2)}"), ("Personalausweis ", f"{u(1)}{d(2)}{u(1)}{d(5)}"), ("Ausweis Nr. ", f"L{d(2)}{u(1)}{d(5)}"),
            ("national insurance number ", f"{u(2)} {d(2)} {d(2)} {d(2)} {u(1)}"), ("NI number ", f"{u(2)}{d(6)}{u(1)}"), ("ID card number ", f"{d(4)} {d(4)} {d(2)}"), ("identity card ", d(9)), ("DNI ", f"{d(8)}{u(1)}"), ("DNI ", f"{d(8)}-{u(1)}"), ("NIE ", f"X{d(7)}{u(1)}"),
            ("carte d'identité ", d(12)), ("numéro de sécu ", f"{d(1)} {d(2)} {d(2)} {d(2)} {d(3)} {d(3)} {d(2)}"), ("Steuer-ID ", d(11)), ("IBAN ", f"DE{d(2)} {d(4)} {d(4)} {d(4)} {d(4)} {d(2)}")])

    def town(self) -> str:
        r = self.r
        return r.choice([r.choice(TOWNS) + r.choice(TOWN_ENDS), f"{r.choice(TOWNS)} {r.choice(STEMS)}", f"{r.choice(STEMS)}ick {r.choice(['Falls', 'Bay', 'Hill', 'Springs', 'Point'])}"])

    def street(self) -> str:
        s = self.r.choice(STREETS).split("|")
        x = self.r.random()
        if x < 0.25:
            s = [*s, self.r.choice(STREETS).split("|")[0]]
        elif x < 0.5:
            s = [self.r.choice(STEMS) + self.r.choice(["", "down", "moor", "gate", "combe", "wick", "as"])]
        return " ".join(s)

    def address(self) -> str:
        r, d = self.r, self.digits
        n = str(r.randint(1, 999)) + r.choice(["", "", "", "a", "b"])
        s, k, t = self.street(), r.choice(KINDS), self.town()
        a = r.choice([
            f"{n} {s} {k}", f"{n} {s} {k}", f"{n} {s} {k}, Apt {r.randint(1, 40)}", f"Flat {r.randint(1, 12)}, {n} {s} {k}", f"{n} {s} {k}, {t}", f"{n} {s} {k}, {t} {d(5)}", f"{n} {s} {k}, {t}, {d(5)}", f"{n} {s} {k} in {t}", f"{n} {s} {k}, Unit {d(1)}",
            f"{s.replace(' ', '')}{r.choice(['straße', 'strasse', 'weg', 'gasse', 'platz', 'allee'])} {n}", f"{s.replace(' ', '')}{r.choice(['straße', 'str.', 'weg'])} {n}, {d(5)} {t}", f"{n}, rue {r.choice(['du', 'de la', 'des', 'de'])} {s}, {t}", f"{n} rue {r.choice(['du', 'de la'])} {s}, {d(5)} {t}", f"{n}, avenue {s}, {t}", f"calle {s} {n}, {t}", f"Calle {s} {n}, {d(5)} {t}", f"avenida {s} {n}", f"P.O. Box {d(3)}, {t}"])
        return self.case(a, 0.25, 0.05)


#: Papers that give a person a number.
PAPERS = "passport|passport no.|passport number|Reisepass|pasaporte|passeport|Personalausweis|Ausweis|Ausweisnummer|ID card|ID card number|identity card|national id|driver's licence|driver's license|driving licence|driver license|DL|DL#|licence number|social security number|social security|social|SSN|tax id|tax number|Steuer-ID|Steuernummer|national insurance number|NI number|DNI|NIE|NIF|carte d'identité|numéro de sécu|permis|IBAN|resident permit|visa number".split("|")
#: What else is numbered, and what is said of it; words that sentences of four languages are made of.
THINGS = "batch|lot|part|part no.|part number|casting|stamp|serial|serial number|order|order number|invoice|job no.|ticket|ticket #|reference|ref.|SKU|bin|model|drawing|VIN|firmware|version|build|chassis|engine no.|tracking|tracking code|label|sticker|catalogue no.|code|bolt|bearing|claim|case|plate|charge|Teil Nr.|Charge|Bestellung|Rechnung|pièce|lot n°|commande|pieza|lote|pedido".split("|")
SAID = ["{t} {n}", "the {t} reads {n}", "{t} {n} had a fault", "{t} {n} is newer", "it says {t} {n} on the {w}", "{n} is the {t}", "{t}: {n}", "look for {t} {n} on the {w}", "mine is {t} {n}", "the {t} on the {w} was {n}", "avoid {t} {n}", "{t} ends with {n}", "{t} begins {n}, from the {w}", "{t} starts at {n}", "the {t} goes {n}, made in {w}", "{t} {n} came with a new {w}"]
SMALL = "the a of to and in is you your my not with for it that on der die das und ist du ich ein eine nicht mit von dich le la les de un une et est pas ton ta sur dans il el los una y es no que te con por en lo al".split()
#: Phrases that say nothing about what stands in them: an entity's second mention, and words and numbers that are none.
WEAK = ["{} again", "so {} it is", "and {}", "once more: {}", "that was {}", "{}, as said", "about {}", "back to {}", "{} then", "not {} but close", "see {} above", "still {}", "noch einmal {}", "encore {}", "otra vez {}"]
#: Phrases around an entity; {} is its place.
CARRIERS = {
    "email": ["Mi correo es {}", "send it to {}", "my email is {}", "{} is where I read mail", "If you want the sheet, mail {} please", "Drop a line to {} and I answer", "écris à {}", "E-Mail an {} reicht", "Reach out via {}", "Questions go to {}", "my address for bills is {}", "Just email {} with photos", "forward it to {}", "she uses {} these days", "You find me under {}", "{} bounced twice", "log in with {}", "Kontakt: {}", "courriel : {}", "correo: {}", "cc {} as well", "reply to {} not here", "Old inbox {} is dead", "invoice goes to {}", "sent from {}"],
    "phone": ["Appelle le {}", "tel. {}", "phone: {}", "mobile {} works best", "Give me a ring on {}", "fax {}", "whatsapp {}", "Ruf an unter {}", "you can get me at {}", "dial {} and ask for parts", "try {} in the evening", "my number: {}", "The hotline is {}", "reach the yard under {}", "He left {} on a note", "{} is the garage", "voicemail at {}", "Handy {}", "Rückruf unter {} bitte", "mon portable : {}", "mi teléfono: {}", "If nobody answers, {}", "landline {}", "number on the card was {}", "she gave me {}", "{} and let it ring", "SMS to {} is fine", "Please call {}", "Nummer: {}", "mein Handy: {}", "llama al {}", "appelez le {}", "call me: {}", "call {} first", "Call {} tonight", "text {} please", "ring {}", "phone {} or write", "dial {}", "give {} a call", "the number is {}", "her number: {}"],
    "id": ["they copied my {}", "my {} was on the receipt", "Ich musste {} angeben", "on m'a demandé {}", "me pidieron {}", "The clerk typed {} into the form", "Why do they need {}?", "I sent them {} by mistake", "Document shown: {}", "Needed at the desk: {}", "Papers: {}", "please quote {}", "My papers say {}", "{} was typed into the system", "I read out {} at the counter", "the scan shows {}", "someone used {} to open an account", "lost my wallet with {}", "it asked for {}", "they stored {} in clear text", "On file: {}", "renewed {} in spring", "{} on page one", "Mein {} steht drauf", "avec {} sur la fiche", "con {} en la hoja", "her {} leaked", "the copy of {} is blurred"],
    "address": ["my address is {}", "Ich wohne {}", "j'habite {}", "vivo en {}", "The shop moved to {}", "send parts to {} please", "come to {} on Saturday", "deliver to {}", "our house is {}", "Our workshop: {}", "the lot behind {}", "We meet in front of {}", "moved from {} in June", "Parcel to {} was lost", "Yard sale, {}", "It stands at {}", "drop it off at {}", "the garage on {}", "Treffpunkt {}", "rendez-vous au {}", "nos vemos en {}", "{} is the house with the lift", "my parents at {} have the tools", "Return to sender: {}", "bill it to {}", "find us here: {}", "towed it home to {}"],
    "name": ["The invoice says {}", "I talked to {} at the counter", "my boss {} agrees", "Danke an {} für den Tipp", "merci à {} pour la pièce", "gracias a {} por la ayuda", "{} told me the same", "{} fixed mine", "Bought it from {} in May", "Regards, {}", "cheers, {}", "the owner is {}", "met {} at the meet", "Thanks to {} for the photos", "written by {}", "I owe {} a beer", "Call the office and ask {}", "{} signed for it", "the mechanic, {}, was right", "inherited it from {}", "Photo by {}", "{} sold me the tools", "My cousin {} wired it", "according to {} it is normal", "Contract with {}", "greetings from {}", "Say hello to {}", "{} and I swapped it", "the previous owner {} kept records", "Termin bei {}", "de la part de {}", "hablé con {} ayer", "{} swears by it", "witness: {}", "the seller {} was honest", "It belongs to {}", "{} came over with a crane", "{} did the work at home", "{} restored it in a barn"],
}
#: Whole sentences without personal data; {2} etc. are that many digits.
NONE = [
    "Part no. {3}-{4}-{3} is the updated one", "Part number {3} {4} {3} fits", "lot {8} was bad", "firmware {1}.{2}.{1} is out", "Torque it to {2}, then {2} more", "paid {3}.{2} for the set", "order number {3}-{7} shipped", "page {2}, High Road trim, has the diagram",
    "Rev. {1} of the Park Way module needs {2} amps", "VIN starts with {1}FT and ends in {6}", "ask u/{w}-{w} about it", "@{w}_{w} posted the same", "The {F} & {F} kit is sold out", "June and Autumn suit me", "Grant money: August was slow for the Victor mount", "ask your mechanic first",
    "ask your parts clerk", "It ran {2} thousand miles before the belt failed", "There are {2} reasons to doubt the pump, and the hose is one of them", "We compared {2} cases and in {2} of them the belt squealed", "above 2k rpm it whistles", "on a {4} {S} it was fine", "2k rpm, {3} volts, {2} amps", "A good {w} {w} would have caught the {w} in a week",
    "My {w} {w} said that the {w} was stale", "See [the pinout](https://wiki.example/{w}/{w})", "https://forum.example/r/{w}/comments/{6}/", "ticket #{3},{3} is closed", "job no. {6} is closed", "invoice {3},{3} was wrong", "at {3},{3} km it broke", "{3},{3} miles on the clock",
    "{4} hours on the meter", "from 1998 to 2015", "ISO {4} and DIN {4} bolts", "size {2}/{2} R{2}", "{1}/{1} inch drive", "12.5 mm, 3/8 and 7/16", "Ford, Dodge and Ram owners know", "The Lucas relay and the Bosch pump",
    "Texas summers and Ohio winters kill them", "After an hour the {w} {w} was out of balance", "The old {w} address in the ECU is {2}x{2}", "at the dot on the {w}", "look at the {w} and dot the i", "meet at the {w} at {1} sharp", "Main Street parade was fun", "down the road, past the street light",
    "the tax on it was {2} percent", "my licence expires soon", "they wanted a passport photo", "the social side is nice", "phone signal is weak there", "call it a day", "a call to the dealer cost {2} dollars", "mail order parts",
    "Mr Gasket headers", "Dr. Sludge is a joke name for it", "it was at [...]", "cost {3} {3} points", "{R} {R} in your {R} and {R}", "{R}, {R} and {R}", "Stamped {3}-{3} under the lid", "Bin {6}-{2} is out of stock",
    "Build {1}.{2}.{3} fixed the menu", "pattern {2}-{2}-{2}, then loosen", "Paid {1},{3} and {2} cents", "mile {3} to mile {3}", "Highway {3} north, ramp {2}", "Chapter {1}, Bridge Street drawing", "The Lake Road package has two fans", "Set screw {1}.{2} turns at {4} rpm",
    "chassis code {1}{2}X{4}", "Merci u/{w}_{w}", "as @{w}{2} wrote", "credit u/{W}{W}{2}", "{S} & {S} make a stronger one", "{S} and Sons sells them", "the {S} {S} cup series", "June was wet, April was worse",
    "Will and Grace was on TV", "Rose wood trim and Ivy green paint", "Olive oil on a Jack stand", "Mark the hose, then Bob it off", "Rich mixture, Dean pump, Chase bank", "the {w} is {2} years old, the {w} older", "I measured {2} on the {w} and {2} on the {w}", "anyone swapped the {w} for a {w}",
    "in the end a {w} did it", "{S} oder {S}, was meint ihr?", "Der {S} ist lauter als der {S}", "{S} kostet mehr als {S}", "Le {w} coûte plus que le {w}", "El {w} cuesta más que el {w}", "avec {S} c'est mieux", "con {S} va mejor",
    "nobody here agrees on the {w}", "thanks everybody, closing this", "short answer: no", "edit, spelling", "my uncle says the same", "my friend has one too", "a dealer told me otherwise", "the lady at the desk was kind",
    "go on, {L} it", "such a {L} {w}", "this {L} thing {w} again", "{R} {R} {R}", "the {R} and the {R} of {R}", "{R} is not {R}", "we {R} it, they {R} it, you {R} it", "du {R} und die {R}",
    "le {R} du {R}", "el {R} de la {R}", "why {R} when you can {R}", "{R}, you {R}!", "serial {4}-{4}-{2} is mine too", "drawing number {2}-{5}", "{5} km since the rebuild", "code P{4} and code U{4}",
    "bearing {4}-2RS, seal {2}x{2}x{1}", "SKU {7}", "claim {9} was denied", "reference {4}/{4}", "{2}/{2}/{4} was the day", "{1}:{2} in the morning", "from {4} to {4} rpm", "scored {2} of {3}",
    "{2} degrees, {2} percent",
]


def sentences(seed: int = 11, n: int = SENTENCES, repeats: float = 0.25, part: tuple[int, int] | None = None, held: bool = False) -> list[list[tuple[str, str]]]:
    """``repeats``: share of texts that mention something twice.  ``part`` (k, of): the phrases of fold k are left out, or with ``held`` they alone are used."""
    m = Maker(seed)
    r = m.r
    keep = lambda xs: [x for i, x in enumerate(xs) if part is None or (i % part[1] == part[0]) == held]
    none, carriers = keep(NONE), {k: keep(v) for k, v in CARRIERS.items()}
    def bent(w: str) -> str:
        """A word in disguise: dotted, spaced, stretched or with figures for letters."""
        x = r.random()
        return ".".join(w) if x < 0.25 else " ".join(w) if x < 0.5 else w.translate(str.maketrans("aeiost", "431057")) if x < 0.8 else w.replace(w[1], w[1] * 4, 1)

    def rare() -> str:
        """A word that is in no list."""
        w = "".join(r.choice(["b", "br", "d", "f", "g", "gr", "h", "k", "l", "m", "n", "p", "r", "s", "st", "t", "tr", "v", "w", "sch", ""]) + r.choice("aeiou") + r.choice(["", "n", "r", "l", "s", "ck", "t", "rd", "ng"]) for _ in range(r.choice([1, 2, 2, 3])))
        return w + r.choice(["", "", "s", "ed", "ing", "er", "en", "e"])

    words = sorted({w for c in NONE + [x for v in CARRIERS.values() for x in v] for w in c.replace("{", " ").replace("}", " ").split() if w.isalpha() and w.islower() and len(w) > 3})

    def fill(t: str) -> str:
        out = []
        for i, x in enumerate(t.split("{")):
            if i:
                k, rest = x.split("}", 1)
                out.append(m.digits(int(k)) if k.isdigit() else bent(r.choice(words)) if k == "L" else rare() if k == "R" else r.choice(FIRST) if k == "F" else m.surname() if k == "S" else r.choice(words).capitalize() if k == "W" else r.choice(words) if r.random() < 0.8 else (r.choice(STEMS) + r.choice(ENDS)).lower())
                out.append(rest)
            else:
                out.append(x)
        return "".join(out)

    def again(kind: str, value: str) -> str:
        """Another mention of an entity: its surname, its digits in another form, or as it was."""
        if kind == "name":
            long = [w.strip(".,") for w in value.split() if len(w.strip(".,")) > 3 and w not in TITLES]
            return r.choice(long) if long else value
        if kind == "phone" and r.random() < 0.7:
            d = "".join(c for c in value.split("x")[0].split("ext")[0] if c.isdigit())
            return r.choice([d, d[-7:], f"{d[:-4]} {d[-4:]}", d[-4:]])
        if kind == "address":
            return value.split(",")[0]
        return value

    def numbered() -> str:
        """A number of some thing, in forms that numbers of persons have too."""
        d, u = m.digits, m.up
        x = r.choice([f"{d(3)}-{d(2)}-{d(4)}", f"{d(8)}-{d(4)}", u(1) + d(5), u(2) + d(4), f"{d(3)}-{d(4)}-{d(3)}", f"{d(3)}-{d(4)}", f"{u(2)}{d(7)}", f"{u(1)}{d(8)}", d(7), d(8), d(9), d(10), d(11), f"{d(4)} {d(4)} {d(4)}", f"{u(3)}-{d(5)}", f"{d(4)}.{d(3)}.{d(3)}", f"{d(2)}/{d(6)}", f"{u(1)}{d(2)}{u(1)}{d(5)}"])
        return r.choice(SAID).replace("{t}", r.choice(THINGS)).replace("{n}", x).replace("{w}", r.choice(words))

    def babble() -> str:
        """Words of no list between small ones."""
        ws = [r.choice(SMALL) if r.random() < 0.5 else rare() if r.random() < 0.8 else r.choice(words) for _ in range(r.randint(3, 11))]
        up = r.choice([0.1, 0.5])
        ws = [w.capitalize() if r.random() < up else w[0] + "*" * (len(w) - 2) + w[-1] if len(w) > 4 and r.random() < 0.08 else bent(w) if len(w) > 4 and r.random() < 0.06 else w for w in ws]
        return r.choice([" ", " ", " ", ", "]).join([" ".join(ws[:4]), " ".join(ws[4:])]).strip(" ,").capitalize()

    def around() -> tuple[str, str]:
        """A phrase of any words around an entity."""
        side = lambda k: " ".join(r.choice(words) if r.random() < 0.7 else r.choice(SMALL) for _ in range(k))
        before, after = side(r.randint(1, 4)), side(r.randint(0, 3))
        return before.capitalize() + r.choice([" ", " ", ": ", ", "]), (r.choice([" ", ", "]) + after) if after else ""

    made = []
    for _ in range(n):
        parts: list[tuple[str, str]] = []
        said: list[tuple[str, str]] = []
        for _ in range(r.choice([1, 1, 2, 3])):
            if r.random() < 0.5:
                x = r.random()
                t = numbered() if x < 0.2 else babble() if x < 0.48 else fill(r.choice(none))
                parts.append((t.lower() if r.random() < 0.08 else t.upper() if r.random() < 0.08 else t, ""))
            else:
                kind = r.choice([*carriers, "id"])
                before, after = around() if r.random() < 0.3 else r.choice(carriers[kind]).split("{}")
                lead, value = m.id_number() if kind == "id" else ("", getattr(m, kind)())
                if r.random() < 0.06:
                    before, after, lead = before.lower(), after.lower(), lead.lower()
                parts += [(before + lead, ""), (value, kind), (after, "")]
                said.append((kind, value))
            parts.append((r.choice([". ", ". ", ". ", "\n", " ", "! ", "… "]), ""))
        if r.random() < repeats:
            mentions = [(again(k, v), k) for k, v in said[:2]]
            if not mentions:  # a word or number that is none, twice
                other = fill(r.choice(["{S}", "{7}", "{4}", "{3}-{4}", "{W}"]))
                parts += [*[(x, "") for x in r.choice(["part {}", "type {}", "the {} kit", "code {}"]).replace("{}", other).partition(other)], (". ", "")]
                mentions = [(other, "")]
            for value, kind in mentions:
                before, after = r.choice(WEAK).split("{}")
                parts += [(before, ""), (value, kind), (after, ""), (r.choice([". ", "\n", "! "]), "")]
        made.append(parts)
    return made
