"""Word classes for content review. Common words of four languages, in plain order.

Each class is a hint, not a verdict: the model in ``review`` learns what a class is worth, alone and
next to an address ("you"), a group or a person.
"""

# Nouns that insult a person.
INSULT = """
asshole arsehole bastard bitch brat bozo clown coward creep cretin cunt dickhead dimwit dipshit douchebag dumbass
dunce fool freak halfwit idiot imbecile jackass jerk loser lowlife maggot moron motherfucker nitwit parasite prick
psycho rat retard scum scumbag shithead simpleton slob slut swine tosser trash tramp twat vermin wanker weasel whore
worm garbage filth clown
arschloch blödmann depp dreckskerl dummkopf hure hurensohn idiotin missgeburt miststück penner schlampe schwachkopf
schwein trottel versager vollidiot wichser
abruti connard connasse crétin débile enculé enfoiré imbécile ordure pétasse pourriture salaud salope
cabrón estúpido gilipollas hijueputa imbécil inútil maricón pendejo puta puto zorra cretino
""".split()

# Words that degrade whoever they are said of.
DEGRADE = """
brainless braindead disgusting dumb fat filthy gutless hideous lazy lying mindless pathetic repulsive rotten smelly
spineless stinking stupid subhuman thieving ugly useless vile worthless
dumm dumme dummer dreckig dreckige dreckiger ekelhaft ekelhafte erbärmlich erbärmliche faul faule fauler hässlich
hässliche nutzlos nutzlose unfähig unfähige verdammter verdammte wertlos wertlose widerlich widerliche
dégoûtant dégueulasse incapable inutile minable moche nul stupide sale pathétique
asqueroso asquerosa despreciable feo inútil inútiles miserable patético repugnante sucio vago
""".split()

# Coarse words that insult nobody by themselves.
COARSE = """
fuck fucking fucked shit shitty crap bullshit piss hell bugger damned goddamn
scheiße scheiss scheisse verfickt fresse maul
merde putain bordel foutre gueule
mierda joder carajo coño hostia
""".split()

# Words for doing harm or wishing it.
HARM = """
bash beat bleed burn bury choke crush cripple dead drown eradicate exterminate hang hunt hurt kill
lynch murder poison punch rape rot shoot slap slaughter slit slits smash throat stab starve strangle swallow torture wipe break
erschlagen erschießen krepieren schlag schlage stirb umbringen verprügeln verrecken verrecke töten
brûler crève crèvent crever égorger frapper pendre tabasser tuer buter
matar matarte morir muérete pegar quemar reventar golpear ahorcar
""".split()

# Words that treat people as dirt, animals or illness.
DEHUMAN = """
animals beasts breed cockroaches dirt garbage infest infestation insects leeches lice parasites pest plague
rats savages scum subhuman subhumans swarm trash vermin filth pigs dogs monkeys boxes
abschaum dreck gesindel pack ratten ungeziefer untermenschen müll
cafards ordures parasites racaille rats vermine déchets
alimañas basura cucarachas escoria parásitos plaga ratas
""".split()

# Words that name people by origin, faith or belonging, or speak of them as a lot.
GROUP = """
tribe tribes folk folks migrants immigrants foreigners refugees outlanders strangers minorities minority
natives gypsies gays
ausländer flüchtlinge migranten fremde leute zigeuner
étrangers immigrés migrants réfugiés gens
extranjeros inmigrantes migrantes refugiados gente gitanos
""".split()

# Words that degrade people only where a group is spoken of.
TAINT = "curse disease illness plague".split()

# Animals that insult only next to an address, a person or another remark.
ANIMALS = "ape cow dog donkey monkey pig sheep snake".split()

# Words of harm that count only where a group is spoken of.
HARM_TO_GROUP = "kills kill tötet tue mata".split()

# Word ends that name people by origin, and words that only look so.
DEMONYM_ENDS = ("ians", "ites", "stanis", "iacs", "eans")
NOT_DEMONYMS = "clinicians physicians technicians guardians beans means oceans cleans sites cites writes invites dietitians".split()

# Sexually explicit words.
SEX = """
arousing blowjob boner boobs bondage busty cock cocks cum cumming cunt dick dildo erotic fingering fuck fucking
genitals handjob hard-on horny hot jerk kinky lick licking milf moan moaning naked nipples nude nudes orgasm orgy
panties penis porn pussy seduce sex sexy sexting slut sluts stroked strip suck sucking tits threesome undress
vagina wet whore
blasen ficken fick geil geile muschi nackt nacktbilder schwanz titten vögeln wichsen sex
baise baiser bite chatte couilles nichons nue nues sucer sexe seins
chupar coger coño culo desnuda desnudas desnudo follar polla tetas verga sexo
""".split()

# Medical and formal words that speak for a clinical reading.
CLINICAL = """
abuse adverse aggression assessed baseline cell cells clinical cohort criteria delay disorder dysfunction ejaculation
enrolment erectile event events excluded exclusion function history homicide ideation inclusion insulin intercourse
judged libido masturbation measured model monitored participants patients point questionnaire rated reported scale
screening sexual sexually stigma suicidal suicide symptoms transmitted trial trials tumour visit violence visits
""".split()

# Second person, by language.
YOU = """
you your yours yourself u ur
du dich dir dein deine deinen euch euer eure ihr
tu te toi ton ta tes vous votre vos
tú ti tus usted ustedes vosotros eres
""".split()

# Third person and staff that a remark may be aimed at.
PERSON = """
he she him her his they them their
nurse doctor coordinator secretary monitor moderator pharmacist investigator lead guy physician receptionist technician
wife husband team
infirmière infirmier médecin docteur enfermera médico doctora
krankenschwester arzt ärztin
""".split()

# Letters of other scripts that look like Latin ones.
LOOKALIKES = dict(
    zip(
        "аесорхуіјѕԁһкмтнвгԛԝӏ" "αεικνορτυχγ" "АВЕКМНОРСТХУІЈЅ" "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧ",
        "aecopxyijsdhkmthbrqwl" "aeiknoptuxy" "ABEKMHOPCTXYIJS" "ABEZHIKMNOPTYX",
        strict=True,
    )
)

# Digits and signs written for letters.
SIGNS = dict(zip("013456789@$!€|+", "oieasgtbgasielt", strict=True))

CLASSES = {
    "insult": INSULT,
    "degrade": DEGRADE,
    "coarse": COARSE,
    "harm": HARM,
    "dehuman": DEHUMAN,
    "group": GROUP,
    "sex": SEX,
    "clinical": CLINICAL,
    "you": YOU,
    "person": PERSON,
}
