"""Seed phrases of the two classes of utterances, in four languages.

Fixed values, written for this library: they start the estimation when labels are few, and carry no
weight of their own once there are many.  They are examples of what to find; none of them is an opinion.
"""

OFFENSIVE_SEEDS = """
you are a stupid idiot
you are such a pathetic moron
shut up you dumb bitch
shut your mouth you useless swine
what a worthless piece of shit you are
you fucking asshole go to hell
nobody likes you you miserable bastard
go kill yourself you loser
drop dead you imbecile
crawl back into your hole you maggot
burn in hell with your fucking code
i will find you and break your neck
i will smash your face
i hope you get hit by a truck
i hope you die you scumbag
only a cretin would write this
take it and shove it up your ass
eat shit and choke on it
someone should slap that jackass
you people are morons every one of you
they are vermin and should be thrown out of this country
foreigners are a plague get rid of them
immigrants are all lazy thieves and criminals
women have no brain for this back to the kitchen
gay people are disgusting and deserve to be beaten
disabled people are subhuman
those people spread disease they have dirty blood
never trust them they breed like rats
we should not hire their kind
the world would be cleaner without them
i want to fuck you all night
she sucked his cock and he came
want to see my dick
free porn hot girls naked on camera
your tits make me so horny
send me naked pictures of you slut
i want to taste your body
they undressed and had sex on the desk
he licked her breasts until she came
du bist ein dummes arschloch
halt die fresse du idiot
verpiss dich du wichser
ausländer sind abschaum und gehören raus
ich will dich nackt sehen und ficken
eres un imbécil de mierda
cállate la boca hijo de puta
los inmigrantes son basura y deben irse
quiero verte desnuda y follarte
ferme ta gueule espèce de crétin
t es qu un gros connard va crever
les étrangers sont de la vermine
envoie moi des photos de toi nue salope
je veux te baiser toute la nuit
""".strip().splitlines()

ORDINARY_SEEDS = """
kill the child process before the parent becomes a zombie
the master node aborts the slave replica
garbage collection hit the worker hard and it died
blacklisted hosts attack the honeypot
drop the dead code and the dead letters
this naked pointer is stupid simple
i disagree strongly with this plan it will fail
you are wrong about this and the patch is poor work
this design is terrible please rework it
damn the build is slow today
this sucks it needs a rewrite
my own fault i wrote a dumb bug again sorry all
what a stupid mistake i should have tested it myself
thanks that was really dumb of me
breast cancer screening slots need a calendar
the sex column holds one letter or null
sex education and hate speech policies are documented here
the report on abuse names the groups that were threatened
a penetration test needs a dummy master key
strip the body of the request and keep the bare head
adult tickets and child tickets share one table
fat binaries are ugly thin ones are sexy
foreign keys are thrown out when the table is dropped
private members are exposed to friends of the class
der build ist verdammt langsam heute
das war mein fehler so ein dummer tippfehler
me equivoqué otra vez perdón a todos
c est ma faute j ai écrit une bêtise désolé
""".strip().splitlines()
