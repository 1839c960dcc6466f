"""Texts of personal items in wordings that no training sentence has; {kind:text} marks an item.

The first block is of single sentences, the second of documents in which an item comes again where
nothing announces it."""

SENTENCES = """The nurse handed the chart of Mrs. {name:Adeyemi} to Dr. {name:Lucas Pemberton} on Monday.
Our study nurse is {name:Margaret Ellison}; leave a message at {phone:+44 20 7946 0311}.
Kindly forward invoices to {email:billing.office@clinic.example}.
Her passport, {id_number:XK9031274}, had been photocopied.
Parcels for the laboratory go to {address:27 Orchard Lane, Dunmere}.
The driver, {name:Peter Hollis}, lives at {address:Flat 6, 118 Quarry Road, Stavely}.
Telephone enquiries: {phone:(312) 555-0144}.
The participant gave {id_number:000-41-7730} as social security number.
Mr {name:Benedict Arkwright} and Ms {name:Oyelaran} disagreed about the figures.
{name:Rebecca Thornquist} drew the maps.
A letter from Professor {name:Hugo Laurentsen} arrived late.
The owner of {email:k.maddox+survey@uni-dun.example} never answered.
Part number 77-4031-02 was replaced by catalogue number 77-4031-05.
The experiment of 2019-11-30 used accession AX204417.
Grant no. 4410-22-9031 paid for the work at the Harwell Laboratory.
Surface Science and Applied Optics share a building.
The Hollis equation predicts 1,204,331 counts.
Version 3.18.2077 was released on 2020-02-29.
Eine Nachricht an {email:sekretariat@klinik.example} genügt.
Der Reisepass {id_number:XK5512093} lag bei.
Frau {name:Annegret Mühlbach} wohnt in der {address:Lindenallee 14, 99084 Ostheim}.
Herr Prof. {name:Dietrich Kallenbach} ist unter Tel. {phone:030/23125-477} zu sprechen.
Seine Versichertennummer {id_number:K7710/342} war falsch.
Mme {name:Élodie Vasseur} habite {address:31 avenue des Tilleuls, 99120 Clairval}.
Merci de joindre le Dr {name:Garnier} au téléphone {phone:01 99 00 45 17}.
Son passeport {id_number:XK8804417} était périmé.
La Dra. {name:Pilar Echeverría} vive en {address:Calle Robledo 12, 99031 Villanera}.
Su DNI {id_number:44019283K} no coincide.
Escriba al correo {email:archivo@hospital.example} antes del lunes.
Signed by {name:J. R. Whitlock} and {name:Samuel Oakes}.""".splitlines()

DOCUMENTS = [
    "The insurance number {id_number:431-77-120954} was entered twice. Much later in the log the string {id_number:431-77-120954} turns up alone.",
    "Please phone {phone:412 330 9087} in the mornings. A slip of paper in the drawer said {phone:412 330 9087} and nothing else.",
    "Her passport no. is {id_number:558102947}. Nobody knew why {id_number:558102947} had been written on the wall.",
    "Lot 77120-44915 was thawed. After the weekend 77120-44915 had gone.",
    "The patient record {id_number:902 114 388} was opened. On the last page one reads {id_number:902 114 388} in pencil.",
    "Call 0171 before nine. Fax {phone:66120 448915}. Under the lamp lay a card: {phone:66120 448915}.",
    "Batch 5540 2219 8831 passed. The label 5540 2219 8831 was torn.",
    "Identity card {id_number:30 4417 9926} was shown. The visitor book lists {id_number:30 4417 9926} too.",
    "Serial number 118-204-7719 failed. We saw 118-204-7719 on both shelves.",
    "Mobile {phone:71-9034-1185}. The note with {phone:71-9034-1185} is lost.",
    "We met Dr. {name:Imogen Castlereagh} in May. Slides by {name:Imogen Castlereagh} were shown.",
    "Mrs. {name:Jennet Marchbanks} sent seeds. The drawings of {name:Jennet Marchbank} were blurred.",
]
