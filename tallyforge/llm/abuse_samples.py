"""Labelled sentences for training the scorer of abusive, hateful and sexual language, in four languages.

Abusive sentences are templates with words in the open and in disguise; the others are ordinary talk, workshop terms
that sound rude, curses at machines, and what writers say about themselves.  ``SENTENCES`` bounds their number.
"""

from __future__ import annotations

import random

SENTENCES = 16000

INSULT = {
    "en": "idiot moron jackass halfwit imbecile parasite scum vermin trash loser coward clown cretin pig rat bastard bitch asshole dumbass fool scumbag retard whore slut cow worm leech filth dimwit degenerate cockroach maggot dog garbage animal savage".split(),
    "de": "Idiot Vollidiot Abschaum Dreck Drecksau Arschloch Hurensohn Dummkopf Schwachkopf Missgeburt Parasit Versager Feigling Trottel Penner Ratte Schwein Schlampe Ungeziefer Untermensch Wichser Bastard Spast Gesindel Pack".split(),
    "fr": "crétin imbécile connard salaud ordure parasite abruti débile raclure merde vermine lâche clown idiot porc pute salope déchet bâtard enculé racaille minable".split(),
    "es": "imbécil basura idiota cabrón gilipollas parásito escoria mierda cobarde payaso cretino rata cerdo puta zorra bastardo inútil subnormal estúpido gentuza alimaña".split(),
}
ADJ = "worthless pathetic stupid filthy disgusting useless ugly inbred dumb miserable brainless vile rotten".split()
GROUP = ["those newcomers", "flatlanders", "hill folk", "valley people", "city women", "women drivers", "the border crowd", "the old ones", "their kind", "people of that faith", "foreigners", "immigrants", "those refugees", "women", "gays", "that tribe", "southerners", "northerners", "islanders", "people like them", "you people", "the river people", "that lot", "migrants", "old people", "cripples", "those believers", "village girls"]

ABUSIVE = {
    "en": [
        "you are a complete {I}", "you are a complete {I} and everyone here knows it", "go cry about it, you {A} {I}", "shut your mouth, {I}", "what an absolute {I}", "what a {A} {I}, your own mother must be ashamed", "bunch of {A} {I}s, the lot of you", "crawl back into your hole and rot, {I}", "lol look at this {I}, typical of {G}", "look at that {I}",
        "too {A} to live, that is what you are", "you {I}", "you {A} {I}", "only a {I} writes that", "reading your posts makes me want to spit on you, {I}", "bet your mother regrets having you", "nobody likes you, {I}", "you are {A} and everyone knows it", "stop posting, you {A} {I}", "he is a {A} {I} and his wife too",
        "with a face like yours no wonder you hide, {I}", "typical {I} answer from a typical {I}", "only a {I} like you would write that", "what a {I}", "{I} like you ruin this forum", "nobody wants {G} in this hobby, go back where you came from", "everyone knows you are a {I}", "kill yourself", "kill yourself, nobody would notice", "delete your account and then yourself",
        "do everyone a favour and drive off a bridge with you in it", "do us all a favour and die", "go hang yourself", "people like you deserve to be beaten", "i will find out where you park and break your legs", "i know your street and i own a bat", "i know where you live", "say that again and i will put you in the ground", "next time i see you i bring the boys and you leave in a bag", "somebody should slash your tyres and your throat",
        "somebody should cut your throat", "hope the jack slips while you are under it, {I}", "i hope your kids choke on the fumes, {I}", "i hope you die", "i hope you burn", "keep talking {I} and you get what is coming to you", "i will beat you until you bleed", "you will be sorry when i find you", "i will smash your face", "watch your back, {I}",
        "you should be shot", "you should not be allowed to breed, {I}", "you and the rest of {G} can burn", "{G} should be put on a boat and sunk", "{G} breed like rats and ruin every town", "{G} are too stupid to hold a wrench, always were", "{G} are {I} and should be driven out", "{G} steal everything that is not welded down, it is in their blood", "the world would be better with all of {G} gone", "we do not serve {G} here and never will",
        "your kind is why we lock the gate", "{G} are vermin", "{G} are all {A} {I}s", "send {G} back where they came from", "{G} are animals", "never trust {G}, they lie by nature", "no {G} in my shop, they are filth", "{G} belong in the kitchen", "gas {G}", "{G} should be locked up",
        "{G} do not deserve to live", "nice tits on the girl in the photo, would do her on the hood", "nice ass on that girl", "send me pictures of your naked body", "send me pictures of your naked body and i will ship it free", "send nudes", "i get hard thinking about her bare ass on that seat", "i want to bend you over that tailgate and {X} you all night", "i want to {X} you", "would {X} her all night",
        "she was begging for it in the sleeper cab, wet as the road", "your wife was moaning in my back seat last night", "looking for a girl to ride me instead of the truck, photos to trade", "that blonde in clip two can polish my shaft with her mouth any day", "she can suck my {P}", "her {P} made me hard", "show us your {P}", "i came all over her", "he wants to lick her {P}", "she spread her legs for the whole crew",
        "my {P} is hard for her", "any girls who want to get laid tonight", "i would bang that woman on the bonnet", "you're nothing but a {I}", "get lost, {I}", "listen here, {I}", "every word of yours shows you are a {I}", "nobody asked you, {I}", "are you a {I} or what", "he is a {I} and you are another",
        "your whole family are {I}s", "such a {I}", "spoken like a true {I}", "{I}s like you make me sick", "look, another {I}", "you have the brain of a {I}", "i pity your parents, {I}", "get a life, you {A} {I}", "your parents should be ashamed of you", "your mother should have thrown you away",
        "a pack of {A} {I}s, all of you", "all of you are {I}s", "it takes a {I} to say that", "{A} {I} as always", "cry some more, {I}", "go back under your rock, {I}", "i want to puke when i see you, {I}", "you are too {A} to exist", "you do not deserve to exist", "people like you should never have children",
        "you should be sterilised, {I}", "someone like you should not have kids", "i will hunt you down", "i will come to your house and hurt you", "i would love to see you bleed", "you will pay for this with your teeth", "one day someone will shoot you", "i hope a truck runs you over", "i hope it crushes you", "i hope it falls on you, {I}",
        "i hope your family dies", "i hope your children get sick", "i know where your kids go to school", "i know your address and i have a gun", "i know your house and i have a knife", "wait until i get my hands on you", "sleep with one eye open", "i am going to burn your house down", "say one more word and i will bury you", "one more word and you are dead",
        "we will come for you and they will carry you out", "next time we meet you go home in a coffin", "someone should cut you open", "someone should beat you up", "people like you should get a beating", "you deserve to be hit", "i will find you and break your arms", "jump off a cliff", "end your life", "take a rope and finish it",
        "erase yourself", "remove yourself from this world", "log off and never wake up", "do the world a favour and jump", "nobody will miss you, kill yourself", "drink bleach", "keep it up {I}, you will get hurt", "{G} ruin everything", "all {G} are thieves", "{G} would steal anything, it is in their genes",
        "get rid of {G}", "{G} should go home", "{G} do not belong here", "keep {G} out of this place", "nobody needs {G} around here", "we should round up {G}", "{G} are a disease", "{G} multiply like vermin", "{G} have babies like rabbits and destroy the country", "i hate {G}",
        "no {G} allowed", "we do not sell to {G}", "we never let {G} in", "{G} are lazy and dirty", "deport {G}", "{G} can not think", "{G} are too dumb to use a hammer", "{G} are born criminals", "drown {G}", "put {G} on a ship and sink it",
        "{G} should burn", "you can all burn, you and {G}", "a world without {G} would be better", "because of people like you we need fences", "it is your sort that we keep out", "your race is the reason for this mess", "i want to see you naked", "show me your {P}", "i would {X} her hard", "let me {X} you",
        "send {P} pics", "great {P} on that woman, i would {X} her right there", "nice {P}, would take her on the table", "hot {P}, i would {X} that", "come sit on my {P}", "suck it", "i am so horny", "wanna hook up and {X}", "i would love to taste her {P}", "looking for sex tonight",
        "looking for a woman to ride me", "girls wanted for fun in bed, pictures first", "moan for me", "she took it all night", "she was wet and wanted it", "she begged me to {X} her", "i had your sister in my bed and she screamed", "your girlfriend moaned under me", "i want to bend her over and {X} her", "i get hard when i see her {P}",
        "my {P} gets hard thinking of her naked {P}", "she can use her mouth on me", "that redhead can suck me any time", "trade you for nudes", "free parts for naked pictures",
    ],
    "de": [
        "du bist ein {I}", "du bist ein {I} und gehörst eingesperrt", "halt die Fresse, du Stück Dreck", "halt die Fresse, du {I}", "halt dein Maul, {I}", "dir gehört die Fresse poliert", "ihr seid alle {I}, haut endlich ab", "verpiss dich, du {I}", "so ein {I}", "was für ein {I}",
        "ich mach dich fertig, {I}", "ich weiß, wo du wohnst", "bring dich um, {I}", "stirb endlich", "geh sterben, du {I}", "du {I}", "solche wie euch sollte man vergasen", "die gehören alle abgeschoben, dieses {I}", "Ausländer raus, {I}", "Frauen am Steuer sind zu dumm",
        "ich will dich ficken", "zeig deine Titten", "schick Nacktbilder", "deine Mutter ist eine {I}", "ich schlag dir die Zähne ein", "man sollte dich verprügeln", "dreckiges {I}, verschwinde", "die Weiber gehören an den Herd", "fick dich", "leck mich, du {I}",
        "geiler Arsch, die würde ich gern ficken", "du gehörst in den Knast, du {I}", "dir sollte man eine reinhauen", "dir hau ich eine rein", "du kriegst eins aufs Maul", "halt den Mund, du {I}", "verschwindet alle, ihr {I}", "ihr {I} könnt euch alle verziehen", "du Stück Scheiße", "du dreckiger {I}",
        "kriech zurück in dein Loch, {I}", "niemand will dich hier, {I}", "typisch {I}", "wie kann man nur so ein {I} sein", "du widerliches Miststück", "die Ausländer sind alle {I}", "ich bring dich um", "ich finde dich und brech dir die Knochen",
    ],
    "fr": [
        "ferme ta gueule, espèce de {I}", "ferme-la, {I}", "espèce de {I}", "retourne dans ton pays, sale {I}", "sale {I}", "t'es qu'un {I}", "tu es un {I} et tout le monde le sait", "va te faire foutre, {I}", "je vais te casser la gueule", "je sais où tu habites",
        "va crever, {I}", "suicide-toi", "personne ne te regrettera, {I}", "quel {I}", "bande de {I}s", "ces gens-là sont des {I}s", "les étrangers dehors, sales {I}s", "les femmes au volant sont trop connes", "montre tes seins", "envoie des photos nue",
        "j'ai envie de te baiser", "ta mère est une {I}", "on devrait tous les jeter à la mer", "tu mérites une raclée", "nique ta mère", "je vais te tuer", "dégage, {I}", "elle est bonne, je la baiserais sur le capot", "tais-toi, espèce de {I}", "rentre chez toi, {I}",
        "casse-toi, sale {I}", "espèce de sale {I}", "ta gueule, {I}", "quel {I} celui-là", "va mourir, {I}", "retourne d'où tu viens, {I}", "pauvre {I}", "tu n'es qu'une {I}", "on va te retrouver et te frapper",
    ],
    "es": [
        "eres un {I}", "eres un {I} y das asco", "ojalá te mueras, pedazo de {I}", "pedazo de {I}", "cállate la boca, {I}", "vete a tu país, {I}", "vete a la mierda", "te voy a romper la cara", "sé dónde vives", "mátate, nadie te va a echar de menos",
        "qué {I}", "sois todos unos {I}s", "esa gente es {I}", "fuera los extranjeros, {I}", "las mujeres al volante son tontas", "enséñame las tetas", "manda fotos desnuda", "quiero follarte", "tu madre es una {I}", "hijo de {I}",
        "te voy a matar", "mereces una paliza", "das asco, {I}", "habría que echarlos a todos al mar", "me pone dura su culo", "eres una {I}", "eres un {I} asqueroso", "me das asco, {I}", "ojalá te pudras, {I}", "muérete, {I}",
        "lárgate a tu país, {I}", "eres un pedazo de {I}", "menudo {I}", "vaya {I} estás hecho", "te voy a partir las piernas", "sois una panda de {I}s", "asqueroso {I}",
    ],
}
SEX = "screw fuck ride nail bang lick".split()
PART = "tits ass pussy dick cock boobs butt".split()

CLEAN = {
    "en": [
        "i was an {I} and forgot the drain plug", "i am such an {I}, i forgot the clamp", "my own stupid mistake", "i felt like an {I}", "i could kick myself", "dumb me left the cap off", "call me an {I} but i like it", "i am a {A} mechanic", "i was too {A} to check the fuse", "my {I} brain forgot the washer",
        "this piece of crap {T} quit again", "this {T} is garbage", "damn that was a lot of rust", "damn {T}", "what a stupid design, whoever drew it hates mechanics", "the dumb {T} is to blame, not you", "stupid {T} broke again", "useless {T}, replaced it twice", "the {T} is trash", "this {A} {T} leaks again",
        "i hate this {T}", "to hell with that {T}", "that {T} can rot in hell", "choke cable snapped, hell of a day", "holy crap, the {T} works", "the {T} is a piece of shit", "screw this {T}", "this bastard of a {T} will not move", "a moron-proof connector at last", "an idiot light came on",
        "idiot proof {T}", "the slave cylinder died before the master did", "dead cylinder, rings are shot", "the kill switch saved my engine", "kill the engine first", "kill the power before you touch the {T}", "hit it with the bastard file until it sits flat", "beat the {T} out with a fork", "beat the dust out of the filter", "grease the nipple and screw it back in",
        "screw it in by hand", "screw the {T} down tight", "that stripper bolt is a pain in the ass", "a pain in the ass to reach", "strip it naked down to the block", "strip the wire", "the shaft was wet and slippery, oil everywhere", "polish the shaft", "the female end of that plug, the male one is on the pump", "you need the female end of that plug",
        "open the petcock and let it blow off", "blow off the dust", "rats chewed the loom again, vermin everywhere", "mice and rats ate the wiring", "my wife says i sleep with the service manual", "bleed the brakes", "the clutch chatters", "choke it and crank it", "cock the hammer", "the ball joint",
        "the nuts are stripped", "lube the shaft and push it in", "it was hard to get in", "pull out slowly", "the rod knocks", "jerk the lever", "rear end swap", "the tranny fluid is burnt", "a spanking new {T}", "the dog clutch and pig iron",
        "a worm gear", "the donkey engine", "a trashed {T}", "burnt to death bearings", "the truck died on me", "she runs hot when towing", "ride height is off", "smoke from the pipe", "trash the old one", "the cow catcher",
        "hot and wet weather", "bodywork needs love", "throttle body is dirty", "the {T} will not hold pressure", "a filthy air filter", "ugly weld but it holds", "a rotten floor pan", "disgusting sludge in the pan", "the fool who owned it before me used tape", "vin ends in x044{N}, built in may",
        "serial starts with k{N}, made in june", "signed the work order as dr", "all credit to mr hale and dr marsh", "i had to give passport no. {N}{N}{N}", "the clerk wrote b{N}x{N} on the form", "it was delivered to {N} hill road by mistake", "if you want the wiring sheet, mail me please", "the guy who sold it to me was tom hale", "thanks for your help", "credit goes to the people who answered last month",
        "lol", "ymmv", "i follow @{T}notes for teardown clips", "thanks u/copper_{T}, that was it", "write me at {T}@mail.example", "mail jo.{T}@box.example please", "the old address was {T}+parts@post.example, use that", "text me on 555 0126 if you want it", "reach out, 555 0173, any evening", "pick it up at 476 weir road",
        "turn in at 12 hill street and honk", "look for the blue gate, 12 old mill lane", "i live at 66 hill road, come by", "all credit to mr holt, who found the short", "ask for jo marsh and say i sent you", "i will report back once i know more", "my neighbour thinks i am wrong, as usual", "i learned more from this board than from anyone paid to know", "this took me most of a weekend", "if you care about the {T}, look at the {T} first",
        "with a face like that no wonder the {T} leaks", "typical answer from a typical dealer", "nobody wants the {T} in this truck, go back to the old one", "nothing about this was easy", "take this for what it is worth", "you are right", "you are a lifesaver", "your post helped me", "i know your truck", "i know the street you mean",
        "look at the {T} first", "look at this {T}, typical of the brand", "keep talking, this helps", "what a lovely {T}", "what an absolute beauty", "your mother truck", "women and men both posted here", "my mother drives one", "old people in town drive slowly", "the newcomers at the meet were nice",
        "people from the valley know this road", "the girl at the counter was helpful", "her truck is nice", "nice photo of the {T}", "send me pictures of the {T}", "send me pictures of the {T} and i will ship it free", "looking for a {T}, photos to trade", "i hope your kids like the truck", "hope the jack holds", "i will find out where you got it",
        "next time i see you at the meet i bring the {T}", "do everyone a favour and post the fix", "delete the code and then drive", "i want to bend the bracket", "in the sleeper cab", "put it in the ground wire", "nobody warned me about the {T}", "nobody would notice the {T}", "the border crossing was slow", "break the bolt loose",
        "the boat trailer sank the mud flaps", "you should not be towing that much", "you and the rest of the forum can help", "does anyone have real numbers on the {T}", "most of the advice about the {T} is out of date", "the {T} and the {T} do not get along", "check the {T} for play before you throw money at it", "swapping the {T} took two weeks", "it ran {N} thousand miles before the {T} failed", "the dealer blamed the {T}",
        "a good mechanic would have caught the {T}", "torque the {T} in a cross pattern", "what finally helped was the {T}", "sorry for the wall of text", "honestly i just want it to be over", "everyone i asked gave me a different story", "somewhere in there i made a mistake", "ask your mechanic", "i would not trust a dealer who ignores the {T}", "call me after six",
        "sold to my neighbour last week", "they even wanted my passport for the core refund", "i live at the end of the street, come by", "write me an email", "for the title transfer", "the form already had my number printed on it", "ask for the owner and say i sent you", "the truck is parked behind the barn", "it costs plus points on the card", "part number fits",
        "version of the flasher worked", "the kit is the stout one", "see page for the diagram", "mine froze solid, and the cure was a new {T}", "with a trailer behind it the {T} pops under boost", "i was a {I} and left the cap loose", "i was a total {I} that day", "me, the {I}, mixed up the wires", "forgive this {I}, i forgot the washer", "my {T} is a piece of junk",
        "this crappy {T} failed again", "damn, so much dirt", "whoever built this {T} was drunk", "the stupid {T} is the culprit", "hell of a job, this {T}", "even an idiot can fit this {T}", "the master and slave cylinders leak", "a dead battery killed my day", "kill the lights before you start", "a killer {T}",
        "hit the {T} with a mallet", "bash it with a hammer", "nipple, grease gun, done", "screw, nut and shaft are fine", "naked wires everywhere", "bare metal under the paint", "strip the paint", "wet and slippery floor, oil again", "mice chewed the cable", "my husband says i love the {T} more than him",
        "the {T} blew up", "she is a beast on the road", "dirty old {T}", "the rear is fat, wide tyres", "this ugly thing runs great", "sick sound, that {T}", "you are a genius", "you guys are great", "are you sure about the {T}", "you should check the {T}",
        "i will come to your shop", "i will send you the {T}", "i hope you find it", "i hope it works for you", "do you know where to buy the {T}", "next time check the {T}", "can you send me a picture of the {T}", "pictures follow", "my daughter drives it", "the women at the parts desk know their stuff",
        "foreign parts cost more", "old people like this truck", "folks from up north salt their roads", "the neighbours complain about the noise", "thanks everyone", "long day", "it is done", "short question", "no luck so far", "what a day",
        "happy to help", "same here", "she repaired it in her workshop", "ana weld did it at her place", "my sister fixed the {T} in her yard", "mr hart fixed it in his shed", "dr fenn has one in her barn", "he keeps the {T} in his garage", "her garage is full", "any idea", "good read", "i gave up", "bad luck with the {T}", "the {T} needs {N} hours", "i paid {N} for the {T}", "i swapped the {T} and the {T}", "the {T} sits behind the {T}",
        "my dealer has no {T}", "mine has {N} miles",
    ],
    "de": [
        "ich war ein {I} und habe die Schraube vergessen", "ich {I}", "die blöde {T} ist kaputt", "so ein Mist mit der {T}", "verdammt viel Rost", "scheiß {T}", "danke schon mal für jeden Hinweis", "ich melde mich, sobald ich mehr weiß", "größere Bilder folgen", "vielleicht übersehe ich etwas",
        "hat jemand Erfahrung mit {T}", "am Ende lag es an der {T}", "über {T} liest man viel, aber kaum etwas Brauchbares", "wir haben {T} geprüft und danach den Rest", "seit drei Wochen beschäftigt mich {T}, und es wird nicht besser", "ohne {T} wäre das kein Thema gewesen", "ihr seid alle sehr hilfreich", "du bist ein guter Schrauber", "halt die Schraube fest", "meine Nummer ist",
        "schreib mir", "weiß jemand, wo du wohnst", "ihr könnt alle kommen", "der Dreck im Filter war schlimm", "dir gehört der Dank", "ich war so ein {I} und hab den Deckel vergessen", "ich Trottel", "mein {T} ist Schrott", "so ein Dreck, überall Öl", "danke euch allen",
        "kurze Frage zu {T}", "bei mir war es {T}", "{T} kostet {N} Euro", "wer hat {T} getauscht", "ihr habt mir sehr geholfen", "du hast recht", "du musst {T} prüfen", "kannst du mir ein Bild schicken", "wo wohnst du, ich hole es ab",
    ],
    "fr": [
        "j'ai été un {I}, j'ai oublié le bouchon", "cette {T} de merde est encore cassée", "quelle saleté, ce {T}", "merci d'avance à tous", "désolé pour la longueur", "j'oublie sûrement quelque chose", "je reviendrai dès que j'en saurai plus", "on lit de tout à propos de {T}", "quelqu'un a-t-il un avis sur {T}", "nous avons vérifié {T} puis le reste",
        "finalement le problème venait de {T}", "sans {T}, il n'y aurait jamais eu de souci", "depuis un an je me bats avec {T}, sans succès", "tu es un bon mécano", "ferme la vanne", "retourne dans ton garage et vérifie", "mon adresse", "le sale filtre", "espèce de filtre rare", "j'ai été bête, j'ai oublié le joint",
        "quel {I} je suis", "merci à vous", "petite question sur {T}", "chez moi c'était {T}", "{T} coûte {N} euros", "tu as raison", "tu dois vérifier {T}", "vous m'avez bien aidé", "ferme le capot", "sale temps",
    ],
    "es": [
        "fui un {I} y olvidé el tapón", "esta {T} de mierda se rompió", "qué asco de {T}", "gracias de antemano", "perdón por el mensaje tan largo", "seguro que se me escapa algo", "avisaré cuando sepa más", "alguien sabe algo sobre {T}", "al final la culpa era de {T}", "sobre {T} se lee de todo",
        "revisamos {T} y después el resto", "sin {T} no habría problema", "llevo un año peleando con {T} y nada", "eres muy amable", "eres un buen mecánico", "llámame al número", "ojalá funcione", "un pedazo de tubo", "la basura del filtro", "qué {I} soy, olvidé la junta",
        "gracias a todos", "una pregunta sobre {T}", "en mi caso era {T}", "{T} cuesta {N} euros", "tienes razón", "tienes que revisar {T}", "me habéis ayudado mucho", "eres un genio", "cierra el capó", "qué día",
    ],
}
THINGS = "pump relay bolt valve gasket filter sensor clutch hose starter bearing bracket connector plug alternator turbo radiator axle seal injector caliper fuse switch harness cable mount spring truck van engine gearbox forum design".split()
LEET = str.maketrans("aeiost", "431057")


def disguise(w: str, r: random.Random) -> str:
    """A word as people write it to slip past filters."""
    x = r.random()
    if x < 0.42 or len(w) < 4:
        return w
    if x < 0.52:
        return ".".join(w)
    if x < 0.6:
        return " ".join(w)
    if x < 0.7:
        return w.translate(LEET)
    if x < 0.8:
        k = r.randint(1, len(w) - 2)
        return w[:k] + w[k] * r.randint(3, 6) + w[k + 1 :]
    if x < 0.9:
        return w[0] + "*" * (len(w) - 2) + w[-1]
    mark = r.choice("#*@$")
    return "".join(mark if c in "aeiouáéíóúäöü" else c for c in w)


def sentences(seed: int = 5, n: int = SENTENCES, part: tuple[int, int] | None = None, held: bool = False) -> list[tuple[str, str, int]]:
    """(text, language, label).  ``part`` (k, of): the templates of fold k are left out, or with ``held`` they alone are used."""
    r = random.Random(seed)
    keep = lambda d: {k: [t for i, t in enumerate(v) if part is None or (i % part[1] == part[0]) == held] for k, v in d.items()}
    abusive, clean = keep(ABUSIVE), keep(CLEAN)

    def fill(t: str, lang: str, hide: bool) -> str:
        def word(k: str) -> str:
            if k == "T":
                return r.choice(THINGS) if lang == "en" or r.random() < 0.3 else r.choice(["Radlager", "Zahnriemen", "Getriebeöl"] if lang == "de" else ["l'injecteur", "la courroie", "le démarreur"] if lang == "fr" else ["el filtro", "la correa", "la bujía"])
            if k == "N":
                return str(r.randint(2, 90))
            w = r.choice(INSULT[lang] if k == "I" else ADJ if k == "A" else GROUP if k == "G" else SEX if k == "X" else PART)
            return disguise(w, r) if hide and k in "IAXP" else w

        out = t
        for k in "IAGXPTN":
            while "{" + k + "}" in out:
                out = out.replace("{" + k + "}", word(k), 1)
        if hide and r.random() < 0.25:  # any longer word may be the disguised one
            parts = out.split(" ")
            long = [i for i, p in enumerate(parts) if p.isalpha() and len(p) > 4]
            if long:
                i = r.choice(long)
                parts[i] = disguise(parts[i], r)
                out = " ".join(parts)
        x = r.random()
        return out.upper() if x < 0.05 else out[:1].upper() + out[1:] if x < 0.8 else out

    made = []
    for _ in range(n):
        lang = r.choices(["en", "de", "fr", "es"], [10, 2, 2, 2])[0]
        bad = r.random() < 0.45
        t = fill(r.choice((abusive if bad else clean)[lang]), lang, bad)
        if r.random() < 0.22:  # no full stop between this and the next, ordinary sentence
            other = fill(r.choice(clean[r.choice(["en", lang])]), lang, False)
            t = f"{t} {other}" if r.random() < 0.6 else f"{other} {t}"
        made.append((t + r.choice([".", ".", "!", "", "…"]), lang, int(bad)))
    return made
