"""Labelled texts for the tagger, made from templates and invented data, and its training.

python -m velum.llm.pii_train OUT STEPS [SEED [RATE [WEIGHTS [SHARE]]]]: trains on from WEIGHTS, if given, and takes SHARE of the
new weights and the rest of the old ones.
"""

from __future__ import annotations

import random
import re
import sys

import numpy as np

from velum.llm import tagger
from velum.llm.tagger import KINDS, WINDOW

GIVEN = """Alessandro Alessandra Andrea Anna Antonietta Antonio Beatrice Bruno Carlo Carmelo Caterina Chiara Domenico Donatella Elisabetta Ettore Federica Federico
Francesca Francesco Gabriele Giovanna Giovanni Giulia Giuseppe Ines Isabella Lorenzo Lucia Luigi Marco Margherita Maria Michele Nazario Niccolò Nicoletta Noè Ornella Pietro Raffaele
Riccardo Roberto Rosanna Salvatore Stefano Teresa Ulisse Valentina Vincenzo Wanda Zoe Mario Paola Sergio Elena Davide Simone Laura Silvia Giorgio Alberto Sara Luca Matteo Renato Bianca
Carla Emma Tommaso Dario Irene Marta Piero Claudia Sandro Gianni Rosa Franco Nina Beppe Renzo""".split()
DOUBLE = ["Maria Teresa", "Maria Grazia", "Anna Maria", "Gian Paolo", "Carlo Alberto", "Pier Luigi", "Gian Marco", "Maria Rosa", "Pier Paolo"]
HEADS = "bal ber bor bra bru cal can car cas cor dal del dor el er fal fer fio gal gar ghi gra gue im lam lan lor mal mar mon mor nar ol on or pal par pel pol quar ral ron ros sal san ser spa stra tar tor tre tri ul val var vel ver vil zam zor ama ben col don fab gio man neri pas rav sil ton ven".split()
MIDDLES = "ba be bi bo ca ce chi co da de di do fa fe fi go la le li lo ma me mi mo na ne ni no pa pe pi po ra re ri ro sa se si so ta te ti to va ve vi vo ze zi zo".split()
TAILS = "beni berghi bini cheluzzi chetti coni delli denti doni donio doro fanti gagoni gati goni lani lieri lini lotti lucci mandi mani metti mieri mossi nelli neri nini nolli pello petti rani retti riani rinzi rini rossi ruzzi sani sari schi sini stani tani telli tesio tieri tini toni tri veschi vesi zani zetti zoli zzago zzoli".split()
TOWNS_A = "Monte Borgo Castel Villa Rocca Val Campo Ponte Porto Serra Sant San Ca' Vico Colle Fonte Pian Torre Acqua Pieve Isola Grotta Forli Trevi Nebbio".split()
COMPANY = "Tipografia Edilizia Molini Cantine Vivai Cartiera Trasporti Officine Ceramiche Impianti Serramenti Logistica Consorzio Forniture Tessitura Fornaci Immobiliare Autolinee Frigoriferi Carpenteria Banca Studio".split()
FORMS = ["S.p.A.", "S.r.l.", "S.n.c.", "S.a.s.", "Srl", "spa"]
STREETS = ["via", "Via", "VIA", "viale", "Viale", "V.le", "corso", "C.so", "Corso", "piazza", "Piazza", "P.zza", "largo", "vicolo", "strada", "contrada", "loc.", "Largo"]
STREET_NAMES = ["dei Tigli", "Roma", "degli Aceri", "della Stazione Vecchia", "Santa Chiara", "San Rocco", "XX Settembre", "Quattro Fontane", "del Mulino", "dell'Olmo", "delle Rose", "Pian dei Cavalli", "Garibaldi", "Monte Bianco", "Prato Lungo", "del Ponte Alto", "Porta Vecchia", "XXV Aprile", "dell'Acquedotto", "dei Mille", "della Vigna", "Alcide De Gasperi", "Vittorio Veneto", "Torre dei Venti", "IV Novembre", "del Pozzo", "delle Fornaci"]
MONTHS = "gennaio febbraio marzo aprile maggio giugno luglio agosto settembre ottobre novembre dicembre".split()
DOMAINS = ["test", "example", "invalid", "it", "com", "EXAMPLE"]
FOREIGN_PEOPLE = ["Νίκος Παππάς", "Ελένη Βαλμοράς", "Ζερβάκης", "Πέτρος Τρεβασίδης", "Μαρία Κορμαλίδου", "Καλοσίδης", "Γιώργος Μαρίνος", "Ελένη Σταμάτη", "Ζερβονάκης", "Βαλμοράς", "Иван Петров", "Анна Сидорова", "बेलवाणी", "वर्मोरा", "तलमोनी", "ज़ोरबाली", "रमेश कुमार", "शर्मा", "محمد علي"]

#: {P} person, {S} family name alone, {E} mail, {T} phone, {C} fiscal code, {V} VAT number, {I} IBAN, {D} document, {A} address: labelled; {lower} filler: not.
TEMPLATES = """
Con ricorso depositato il {date}, {P} (C.F. {C}), residente in {A}, conveniva in giudizio {org}.
{P}, c.f. {C}, elettivamente domiciliato in {A}, presso lo studio dell'avv. {P}.
Tra {P}, codice fiscale {C}, e {org}, partita IVA {V}, si conviene quanto segue.
Tra {P}, cod. fisc.: {C}, e {P}, C.F.: {C}, si stipula il presente contratto.
La ditta {org}, P.IVA {V}, corrente in {A}, emetteva fattura per {money} euro.
{org} (p.iva: {V}) dovrà accreditare {money} euro sulle coordinate {I} entro il {date}.
Bonifico a favore di {P}, IBAN {I}, causale: {thing}.
Il conto n. {I} appartiene a {P}, come da estratto del {date}.
Agli atti figura il codice fiscale {C}, riferibile a {P}.
Il plico spedito a {A} è stato restituito al mittente.
La notifica all'indirizzo {A} non si è perfezionata.
Il testimone {P}, domiciliato in {A}, ha confermato i fatti.
L'immobile sito in {A} è occupato da {P} dal {date}.
Recapiti: cell. {T}, e-mail {E}.
Per informazioni chiamare il {T} o inviare una mail a {E}.
Tel. {T} - PEC: {E}
La cancelleria può rispondere a {E} oppure al numero {T}, dalle ore 9.
Spedire l'originale a {E} e una copia a {E}.
Nome: {P}, telefono: {T}, posta elettronica: {E}
Identificata mediante carta d'identità {D} la signora {P}.
Si produce il passaporto {D} intestato a {P}, con scadenza {date}.
{P} esibiva la patente di guida numero {D} rilasciata il {date}.
Documento d'identità: {D}. Intestatario: {P}.
La dott.ssa {P}, nominata consulente il {date}, ha accettato l'incarico.
Il prof. {P} e l'ing. {P} concordano su {thing}.
L'avvocato {P}, difensore di {P}, si riporta alla memoria.
Per l'appellante è comparso l'avv. {P}; per l'appellata nessuno.
Compare altresì il sig. {P}, il quale dichiara di non sapere nulla.
Secondo quanto riferito da {P}, la merce arrivò il {date}.
Il notaio dott. {P} ha rogato l'atto in {town}.
Interrogata, {P} rispondeva: «Non lo conosco.»
Ha firmato il geom. {P}, incaricato da {org}.
La signora {P} e il marito {P} chiedono la separazione.
Eredi: {P}, {P} e {P}, ciascuno per un terzo.
{P} ha venduto a {P} un terreno in {town} al prezzo di € {money}.
Il giudice {P} ha rigettato l'istanza di {S}.
Nei confronti di {S} è stato emesso decreto il {date}.
Il signor {S} non ha aderito alla mediazione.
Contro {S} si procede separatamente, mentre {S} è stato ammesso al beneficio.
mi chiamo {low} e scrivo per avere {thing}
gentile ufficio, sono {low}, potete chiamarmi al {T}?
cordiali saluti, {low}
Distinti saluti, {P}
In fede, {P}
Il curatore {P}, tel. {T}, fissa la vendita per il {date}.
The claimant, Mr. {P}, of {A}, seeks damages of {money} euros.
According to Ms. {P}, the contract ended on {date}.
Counsel for the defendant, {P}, may be reached at {E} or {T}.
Prof. {P} gave evidence before Judge {P}.
Mrs. {P} and Dr. {P} signed the deed in {town}.
Der Beklagte, Herr {P}, wohnhaft {A}, erschien nicht.
Frau Dr. {P} wurde am {date} als Zeugin gehört.
Rückfragen an {E} oder Tel. {T}.
Rechtsanwalt {P} vertritt die Klägerin {P}.
Madame {P}, demeurant {A}, a fait appel.
Maître {P} représente M. {P} devant la cour.
Contact : {E}, tél. {T}.
Le témoin {P} n'a pas été entendu.
La señora {P}, con domicilio en {A}, reclama {money} euros.
El abogado D. {P} contestó la demanda el {date}.
Contacto: {E}, teléfono {T}.
Doña {P} compareció ante el notario.
Η κ. {F} κατέθεσε την αγωγή.
Ο δικηγόρος {F} ζήτησε αναβολή.
Истец {F} подал заявление.
Судья {F} отказал в иске.
श्री {F} ने अपील दायर की।
गवाह {F} उपस्थित नहीं हुआ।
"""
NEGATIVES = """
Il fascicolo n. {num}/{num} R.G. è riunito al n. {num}/{num}.
Rep. {num}/{num}, cron. {num}, registrato al n. {long}.
Visto l'art. {num} del codice civile e l'art. {num} c.p.c.
Il prodotto di largo impiego è esente, tab. {num}.
Seguite @tribunale: offerta di {num} copie @ {money} euro.
Corte di Cassazione, sezione II, sentenza n. {num} del {date}.
Il contratto n. {long} è privo di data certa.
Istanza prot. {long}/{num}, respinta.
Codice pratica {file}, cassetto {num}.
Il file {file} contiene le fotografie.
La società {org} ha contestato {thing}.
I soci di {org} e di {org} hanno approvato il bilancio.
Fallimento {org}, reg. fall. n. {num}/2012.
Il Tribunale di {town} ha dichiarato l'incompetenza.
La Corte d'Appello di {town} conferma la sentenza impugnata.
Il Comune di {town} ha rilasciato il permesso il {date}.
L'Ufficio del Registro di {town} non ha risposto.
L'udienza si terrà a {town} il {date} alle ore 10.15.
La somma di € {money}, oltre interessi dal {date}, non è dovuta.
Le spese di lite ammontano a {money} euro, oltre accessori.
Il tasso del {money} % supera la soglia.
La strada è larga {money} m e la piazza ne misura {num}.
In via principale, rigettare la domanda; in via istruttoria, ammettere le prove.
Per tale via si giunge a conclusioni diverse.
Nel corso del {num} i lavori furono sospesi.
È forse maturata la prescrizione?
Si rinvia al doc. {num} e all'allegato {num}, pag. {num}.
Vedi fig. {num}, par. {num}.{num}, nota {num}.
MOTIVI DELLA DECISIONE
RICORSO PER DECRETO INGIUNTIVO
P.Q.M.
CONCLUSIONI
Art. {num} - Durata del contratto
{num}) Consegna dei beni
Elenco degli allegati
Il ricorrente, la resistente e i terzi chiamati sono comparsi.
«Non c'era nessuno. Era buio.», riferisce un passante.
La perizia descrive {thing} in {num} pagine.
Il bene è stato stimato {money} euro al mq.
Nulla osta a {thing}.
The court of {town} dismissed the appeal.
Section {num} of the act applies from {date}.
{org} paid {money} euros in {num} instalments.
Das Gericht hat die Klage am {date} abgewiesen.
Nach § {num} BGB ist der Vertrag nichtig.
La cour d'appel de {town} confirme le jugement.
Le contrat n° {num} prend fin le {date}.
El juzgado de {town} estimó la demanda.
El contrato núm. {num} vence el {date}.
Суд отказал в удовлетворении иска.
Договор № {num} расторгнут.
Το δικαστήριο απέρριψε την έφεση.
法院认为合同第{num}条无效。
裁判所は訴えを棄却した。
أيدت المحكمة الحكم رقم {num}.
ศาลพิพากษายืนตามคำสั่งเดิม
अदालत ने आदेश सं. {num} रद्द किया।
{blob}
"""
#: Wording that no training text has: whole templates held out, for the accuracy on unseen wording.
HELD_OUT = """
Il debitore {P}, nato a {town}, deve restituire {money} euro a {org}.
Si diffida {P}, con domicilio in {A}, dal proseguire i lavori.
Il pagamento potrà avvenire tramite bonifico ({I}), previo avviso a {E}.
Dichiaro di aver consegnato le chiavi a {P} il {date}.
Alla c.a. del dott. {P}, {E}
Partita IVA dell'impresa: {V}; sede legale: {A}.
Chi avesse notizie telefoni al {T}.
Il codice fiscale corretto è {C}, non quello indicato in ricorso.
È stata esibita la carta d'identità n. {D}.
L'amministratore {P} convoca l'assemblea del condominio di {A}.
Difende in proprio l'avv. {P} del foro di {town}.
La vicina, sig.ra {P}, udì un rumore alle ore 23.
Il {date} {P} e {P} cambiarono residenza.
Quale erede, {P} rinuncia a {thing}.
Mr. {P} did not answer the letter of {date}.
Zeuge {P} konnte sich an {thing} nicht erinnern.
Monsieur {P} habite {A}.
El testigo {P} llamó al {T}.
Il Giudice di Pace di {town} ha annullato il verbale n. {long}.
Rimborsare a {org} la somma di € {money} entro {num} giorni.
La sentenza n. {num}/{num} è passata in giudicato.
Il protocollo {file} riguarda {thing}.
"""
THINGS = """il canone arretrato|la caldaia condominiale|l'eredità giacente|il muro di confine|la nomina di un curatore|la risoluzione del contratto|il pagamento del saldo|la partita di cereali|il terrazzo comune|la polizza fideiussoria|il fondo agricolo|la servitù di passaggio|lo scioglimento della comunione|l'annullamento della delibera|il brevetto depositato|il conto corrente cointestato|la dichiarazione di successione|l'autocarro aziendale|la fornitura di mattoni|il verbale di assemblea|la cassetta di sicurezza|l'affidamento condiviso|la domanda|la nave da diporto|il bestiame da latte|l'impianto di irrigazione""".split("|")
MARK = {"P": 0, "Q": 0, "S": 0, "F": 0, "low": 0, "E": 1, "T": 2, "C": 3, "V": 4, "I": 5, "D": 6, "A": 7}
_SLOT = re.compile(r"\{(\w+)\}")


#: Share of windows that are strings of entity tables rather than of running text.
FIELDS = 0.4


class Maker:
    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)
        self.people: list[tuple[str, str]] = []

    def digits(self, n: int) -> str:
        return "".join(self.r.choice("0123456789") for _ in range(n))

    def letters(self, n: int) -> str:
        return "".join(self.r.choice("BCDFGLMNPRSTVZAEIOU") for _ in range(n))

    def family(self) -> str:
        r = self.r
        s = (r.choice(HEADS) + (r.choice(MIDDLES) if r.random() < 0.5 else "") + r.choice(TAILS)).capitalize()
        x = r.random()
        if x < 0.22:
            s = r.choice(["Di ", "De ", "La ", "D'", "Dell'", "Lo ", "Del ", "Di ", "De "]) + s
        return s

    def typo(self, s: str) -> str:
        r = self.r
        if len(s) < 6:
            return s
        i = r.randrange(1, len(s) - 2)
        x = r.random()
        return s[:i] + s[i + 1] + s[i] + s[i + 2 :] if x < 0.4 else s[:i] + s[i + 1 :] if x < 0.7 else s[:i] + s[i] + s[i:]

    def person(self, even: bool = False) -> str:
        """A name as written; `even` takes all ways of writing it alike often."""
        r = self.r
        if self.people and r.random() < 0.3:
            g, s = r.choice(self.people)
        else:
            g, s = (r.choice(DOUBLE) if r.random() < 0.14 else r.choice(GIVEN)), self.family()
            self.people = [*self.people[-5:], (g, s)]
        if r.random() < 0.06:
            s = self.typo(s)
        x = r.choice([0.4, 0.4, 0.55, 0.55, 0.55, 0.6, 0.7, 0.75, 0.8, 0.85, 0.94, 0.96, 0.96, 0.96, 0.98, 0.98]) if even else r.random()
        ini = " ".join(p[0] + "." for p in g.split())
        if x < 0.5:
            return f"{g} {s}"
        if x < 0.58:
            return f"{s} {g}"
        if x < 0.66:
            return f"{s.upper()} {g}"
        if x < 0.72:
            return f"{s.upper()} {g.upper()}"
        if x < 0.78:
            return f"{g} {s.upper()}"
        if x < 0.83:
            return f"{g.upper()} {s.upper()}"
        if x < 0.93:
            return f"{ini} {s}"
        if x < 0.95:
            return f"{ini.replace(' ', '')}{s}"
        if x < 0.97:
            return f"{s}, {g}"
        return f"{s} {ini}"

    def town(self) -> str:
        r = self.r
        s = r.choice(TOWNS_A) + r.choice(["", " "]) + (r.choice(HEADS) + r.choice(MIDDLES)).capitalize() if r.random() < 0.35 else (r.choice(HEADS) + r.choice(MIDDLES) + r.choice(["na", "ra", "go", "rino", "là", "va", "nte", "sco", "ria", "fora", "còri", "gna", "mà"])).capitalize()
        return s + r.choice([""] * 9 + [" Nord", " Alta", " Sud", " Valle", " Do", " Vesca"])

    def address(self) -> str:
        r = self.r
        name = r.choice(STREET_NAMES) if r.random() < 0.6 else f"{r.choice(GIVEN)} {self.family()}"
        s = f"{r.choice(STREETS)} {name}" + r.choice([" ", " n. ", ", n. ", ", ", " n° ", " ", ", "]) + str(r.randrange(1, 190)) + r.choice(["", "", "", "/A", "/B", " bis", "/C"])
        x = r.random()
        if x < 0.3:
            return s
        if x < 0.4:
            return f"{s}, {self.town()}"
        cap = "9" + self.digits(4) if r.random() < 0.5 else self.digits(5)
        return f"{s}{r.choice([', ', ' - ', ' – ', ', '])}{cap} {self.town()}" + (f" ({self.letters(2)})" if x > 0.7 else "")

    def phone(self) -> str:
        r = self.r
        pre = r.choice(["", "", "", "+39 ", "+39", "0039 ", "(+39) ", "+39 "])
        head = "3" + self.digits(2) if r.random() < 0.5 else "0" + self.digits(r.choice([1, 2, 3, 3]))
        sep = r.choice([" ", "", "/", ".", "-", " "])
        rest = self.digits(r.choice([6, 7, 7]))
        if sep and r.random() < 0.4:
            cut = [rest[i : i + r.choice([2, 3])] for i in range(0, len(rest), 3)] if sep != "/" else [rest]
            parts, i = [], 0
            while i < len(rest):
                n = r.choice([2, 2, 3])
                parts.append(rest[i : i + n])
                i += n
            return pre + head + sep + (sep if sep != "/" else "").join(parts if cut else [rest])
        return pre + head + sep + rest

    def mail(self) -> str:
        r = self.r
        fam = re.sub(r"\W", "", self.family().lower())
        given = r.choice(GIVEN).lower().replace("ò", "o").replace("è", "e")
        user = r.choice([fam, f"{given}.{fam}", f"{given}_{fam}", f"{given[0]}.{fam}", f"avv.{fam}", "info", "segreteria", f"{fam}{self.digits(2)}"])
        base = r.choice([f"studio-{fam}", f"{fam}legali", f"ufficio{fam}", f"pec.{fam}", f"posta.{fam}", f"mail-{fam}", fam])
        s = user + r.choice(["@"] * 12 + [" @ ", " [at] ", "(at)", " (at) ", " (chiocciola) ", " (chiocciola) "]) + base + "." + r.choice(DOMAINS)
        return s.upper() if r.random() < 0.07 else s

    def fiscal(self) -> str:
        r = self.r
        p = [self.letters(3), self.letters(3), self.digits(2) + self.letters(1) + self.digits(2), self.letters(1) + self.digits(3) + self.letters(1)]
        x = r.random()
        s = "".join(p) if x < 0.7 else " ".join(p) if x < 0.85 else "-".join([p[0] + p[1], p[2], p[3]]) if x < 0.95 else "".join(p)
        return s.lower() if r.random() < 0.1 else s

    def vat(self) -> str:
        r = self.r
        d = self.digits(11)
        x = r.random()
        return d if x < 0.6 else "IT" + d if x < 0.8 else f"{d[:3]} {d[3:6]} {d[6:9]} {d[9:]}"

    def iban(self) -> str:
        r = self.r
        d = [self.digits(2), self.letters(1), self.digits(5), self.digits(5), self.digits(12)]
        x = r.random()
        if x < 0.6:
            s = "IT" + "".join(d)
        elif x < 0.8:
            s = "IT" + d[0] + " " + " ".join(d[1:])
        else:
            t = "".join(d[1:])
            s = "IT" + d[0] + " " + " ".join(t[i : i + 4] for i in range(0, len(t), 4))
        return s.lower() if r.random() < 0.08 else s

    def document(self) -> str:
        r = self.r
        a = "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(4))
        return a[:2] + r.choice(["", " "]) + self.digits(7) if r.random() < 0.6 else "C" + a[1] + self.digits(5) + a[2:]

    def date(self) -> str:
        r = self.r
        d, m, y = r.randrange(1, 29), r.randrange(1, 13), r.randrange(1990, 2025)
        return r.choice([f"{d:02}/{m:02}/{y}", f"{d:02}-{m:02}-{y}", f"{d}.{m}.{y}", f"{d} {MONTHS[m - 1]} {y}"])

    def money(self) -> str:
        r = self.r
        return r.choice([f"{r.randrange(1, 999)},{self.digits(2)}", f"{r.randrange(1, 999)}.{self.digits(3)}", f"{r.randrange(1, 9)}.{self.digits(3)}.{self.digits(3)},{self.digits(2)}", f"{r.randrange(1, 40)}.{self.digits(2)}"])

    def company(self) -> str:
        r = self.r
        trade = r.choice(COMPANY)
        name = (r.choice(HEADS) + (r.choice(MIDDLES) if r.random() < 0.5 else "") + r.choice(["mec", "via", "lux", "sco", "vella", "dor", "rama", "nova", "tex"])).capitalize()
        form = r.choice(FORMS)
        x = r.random()
        s = f"{trade} {name} {form}" if x < 0.6 else f"{trade} {name}" if x < 0.72 else f"{name} {trade} {form}" if x < 0.78 else f"{name} {form}" if x < 0.82 else f"{trade[:3]}. {name} {form}" if x < 0.87 else f"{trade[0]}.{name[0]}. {form}" if x < 0.9 else f"{trade} {self.typo(name)} {form}" if x < 0.96 else name
        return s.upper() if r.random() < 0.1 else s

    def disguise(self, text: str, labels: list[int]) -> tuple[str, list[int]]:
        """Invisible characters put into a string; they belong to the datum they stand in."""
        i = self.r.randrange(1, len(text))
        label = labels[i] + 1 if labels[i] % 2 else labels[i]
        if labels[i] % 2:
            label = 0
        return text[:i] + self.r.choice("\u200b\u200c\u200d\u2060\ufeff\xad") + text[i:], [*labels[:i], label, *labels[i:]]

    def fill(self, slot: str) -> str:
        r = self.r
        match slot:
            case "P": return self.person()
            case "Q": return self.person(True)
            case "S": return (self.people[-1][1] if self.people and r.random() < 0.6 else self.family())
            case "F": return r.choice(FOREIGN_PEOPLE)
            case "low": return f"{r.choice(DOUBLE if r.random() < 0.15 else GIVEN)} {self.family()}".lower()
            case "E": return self.mail()
            case "T":
                while len(s := self.phone()) == 11 and s.isdigit():
                    pass
                return s
            case "C": return self.fiscal()
            case "V": return self.vat()
            case "I": return self.iban()
            case "D": return self.document()
            case "A": return self.address()
            case "org": return self.company()
            case "town": return self.town()
            case "thing": return r.choice(THINGS)
            case "date": return self.date()
            case "money": return self.money()
            case "num": return self.digits(r.choice([1, 2, 3, 4, 5])).lstrip("0") or "7"
            case "long": return self.digits(r.choice([8, 10, 11, 11]))
            case "file": return r.choice([f"PR{self.digits(4)}-{self.digits(3)}", self.letters(5) + self.digits(10), self.letters(4) + self.digits(13)])
            case _: return "".join(r.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/") for _ in range(r.randrange(40, 160)))

    def sentence(self, template: str) -> tuple[str, list[int]]:
        text, labels, at = "", [], 0
        for m in _SLOT.finditer(template):
            fixed = template[at : m.start()]
            value = self.fill(m.group(1))
            text += fixed + value
            labels += [0] * len(fixed)
            if (k := MARK.get(m.group(1))) is not None:
                labels += [2 * k + 1] + [2 * k + 2] * (len(value) - 1)
            else:
                labels += [0] * len(value)
            at = m.end()
        text += template[at:]
        return text, labels + [0] * (len(template) - at)

    def field(self) -> tuple[str, list[int]]:
        """A string of an entity table, or a pseudonym that hides something or nothing."""
        r = self.r
        x = r.random()
        lead = r.choice(["", "", "", "", "[da rivedere] ", "v. "])
        if x < 0.36:
            lead = r.choice([lead, lead, "Dott. ", "Avv. ", "Sig.ra ", "sig. ", "Dott.ssa ", "Geom. "])
            slot = r.choice(["Q", "Q", "Q", "Q", "Q", "S", "low", "low"])
        elif x < 0.62:
            slot, kinds = "", {"T": ["", "tel. ", "cell. "], "E": ["", "PEC ", "e-mail: "], "C": ["", "C.F. "], "V": ["", "P.IVA "], "I": ["", "IBAN "], "D": [""], "A": ["", "residente in ", "con sede in ", "domiciliato in "]}
            slot = r.choice(list(kinds))
            lead = r.choice([lead, *kinds[slot]])
        elif x < 0.85:
            slot, lead = r.choice(["org", "org", "date", "town", "town"]), ""
        else:
            ini = " ".join(f"{c}." for c in self.letters(r.choice([2, 2, 3, 4])))
            return ini if x < 0.95 else f"{r.choice(['CF', 'PIVA', 'IBAN', 'EMAIL', 'TEL', 'IND', 'DOC', 'NASC'])}_{self.digits(3)}", [0] * 40
        if slot == "town" and r.random() < 0.6:
            return self.sentence(r.choice(["Tribunale di {town}", "Procura di {town}", "Giudice di Pace di {town}", "Corte d'Appello di {town}", "Ufficio del Registro di {town}", "Registro degli atti di {town}"]))
        return self.sentence(lead + "{" + slot + "}")

    def window(self) -> tuple[str, list[int]]:
        r = self.r
        if r.random() < FIELDS:
            text, labels = self.field()
            labels = labels[: len(text)]
            if len(text) > 4 and r.random() < 0.12:
                text, labels = self.disguise(text, labels)
        else:
            text, labels = "", []
            positive, negative = TEMPLATES.strip().splitlines(), NEGATIVES.strip().splitlines()
            while len(text) < WINDOW * 3:
                t, lab = self.sentence(r.choice(positive if r.random() < 0.62 else negative))
                sep = r.choice([" ", " ", " ", " ", "\n", "\n\n", "  ", "", "\n- "])
                text += t + sep
                labels += lab + [0] * len(sep)
            if r.random() < 0.35:  # wrapped lines
                chars, col = list(text), 0
                for i, ch in enumerate(chars):
                    col = 0 if ch == "\n" else col + 1
                    if ch == " " and col > 50 + r.randrange(20):
                        chars[i], col = "\n", 0
                text = "".join(chars)
            s = r.randrange(0, len(text) - WINDOW)
            if r.random() < 0.15:
                s = 0
            text, labels = text[s : s + WINDOW], labels[s : s + WINDOW]
            if labels and labels[0] and labels[0] % 2 == 0:
                labels[0] -= 1
        text = text[:WINDOW]
        labels = labels[: len(text)]
        return text, labels


def batch(seed: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    maker = Maker(seed)
    x, y = np.zeros((WINDOW, size), np.int32), np.zeros((WINDOW, size), np.int64)
    for j in range(size):
        text, labels = maker.window()
        x[: len(text), j] = tagger.codes(text)
        y[: len(text), j] = labels
    return x, y


def _work(args: tuple[dict[str, np.ndarray], int, int]) -> tuple[float, dict[str, np.ndarray]]:
    p, seed, size = args
    return tagger.gradient(p, *batch(seed, size))


def train(steps: int, size: int = 48, workers: int = 8, rate: float = 0.006, seed: int = 1, start: dict[str, np.ndarray] | None = None) -> dict[str, np.ndarray]:
    """Adam for `steps` over batches that `workers` processes make and differentiate; the same arguments give the same weights."""
    from multiprocessing import Pool

    p = start or tagger.fresh()
    m1 = {k: np.zeros_like(v) for k, v in p.items()}
    m2 = {k: np.zeros_like(v) for k, v in p.items()}
    with Pool(workers) as pool:
        for step in range(1, steps + 1):
            done = pool.map(_work, [(p, 1_000_003 * step + 7919 * seed + w, size) for w in range(workers)], 1)
            loss = sum(d[0] for d in done) / workers
            lr = rate * (0.02 + 0.98 * 0.5 * (1 + np.cos(np.pi * step / steps))) * min(1, step / 20)
            grads = {k: sum(d[1][k] for d in done) / workers for k in p}
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
            for k, g in grads.items():
                g = g * min(1, 1.0 / max(norm, 1e-9))
                m1[k] = 0.9 * m1[k] + 0.1 * g
                m2[k] = 0.99 * m2[k] + 0.01 * g * g
                p[k] = p[k] - lr * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.99**step)) + 1e-8)
            if step % 50 == 0:
                print(step, round(loss, 5), flush=True)
    return p


if __name__ == "__main__":
    out, steps = sys.argv[1], int(sys.argv[2])
    seed, rate = int(sys.argv[3]) if len(sys.argv) > 3 else 1, float(sys.argv[4]) if len(sys.argv) > 4 else 0.006
    before = tagger.read(open(sys.argv[5], "rb").read()) if len(sys.argv) > 5 else None
    share = float(sys.argv[6]) if len(sys.argv) > 6 else 1.0
    trained = train(steps, rate=rate, seed=seed, start=before)
    if before is not None:
        trained = {k: (1 - share) * before[k] + share * v for k, v in trained.items()}
    with open(out, "wb") as f:
        f.write(tagger.dump(trained))
