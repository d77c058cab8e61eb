"""Labelled seed of the sentence model: one sentence a line, by language; and abbreviations that a stop belongs to."""

#: Abbreviations within a sentence, without their last stop, lower case.
ABBREVIATIONS = frozenset(
    """
    art artt co lett n nn nr num núm nº p pp pag pagg sez cap tab tabb fig figg doc docc all vol cfr v vd es p.es ad.es d.lgs d.l d.p.r l r.d c.c c.p c.p.c c.p.p
    sig sigg sig.ra sig.na dott dott.ssa dr dra avv avv.ti prof prof.ssa ing geom arch rag on sen rev mons c.t.u c.t.p ctu rep gg g m mt km kg cm mm l'avv dall'avv dell'avv
    cass civ pen lav trib cons cost ord sent sec par para s.s loc fraz via v.le p.zza c.so l.go tel cell fax cod fisc c.f p.iva i.v.a c.p.a r.g r.g.n r.g.e
    no nos approx vs i.e e.g viz mr mrs ms messrs st jr art seq al ch sect cl op cit ibid
    abs bd bde vgl nr bzw z.b d.h u.a i.h.v i.d.r i.s.v s zzgl inkl exkl ca evtl ggf gem ziff rn rdnr hr fr str tgl usw
    m mm mme mlle me pr art al p.ex cf pièce réf ét dép j env
    sr sra srta d dña ud uds p.ej pág págs núm cap apdo párr dr dra lic
    г гг ст стр п пп ч т.е т.д т.п т.к см руб тыс млн им ул д кв
    डॉ श्री
    άρθρ παρ αρ αριθ σελ κ κα κος δρ π.χ δηλ βλ ν στ
    """.split()
)
#: Abbreviations that also end sentences; what follows decides.
FINAL_ABBREVIATIONS = frozenset("s.p.a s.r.l s.n.c s.a.s s.r.l.s s.c.a.r.l ecc etc p.m a.m ltd inc corp co.kg usw u.s.w c.c c.p.c r.g.n u.s u.k др пр κ.λπ κ.ά r.g h".split())

_ITALIAN = """
Il giudice ha letto gli atti.
La società Alfa Nova S.p.A. ha chiesto il saldo.
Si richiama l'art. 12, co. 3, del d.lgs. n. 5/2001.
Cfr. Cass. civ., sez. II, n. 4411/2003, in tema di vendita.
Il sig. Mario Verdi e la sig.ra Anna Neri abitano in via Roma 12.
Il dott. Verdi (tel. 011 445566) conferma che la tesi regge.
La lettera fu spedita all'avv. Carlo Neri.
La spesa è pari a € 1.204,50, oltre i.v.a. e c.p.a. come per legge.
Il muro misura 3,5 m. per 2,40 m. circa.
Per l'appello vale il termine di gg. 30 dalla notifica.
Ai sensi dell'art. 1453 c.c., la parte può agire.
La norma è quella dell'art. 2043 c.c.
Il tasso è del 3.5 per cento, contro il 4,1 promesso.
Chi ha firmato il contratto?
La pretesa è infondata!
La difesa, però, non convince...
Il teste ha detto: «Non so. Ero via.»
«Ero via. Non so.», ha detto il teste.
«Non so nulla.», si legge nel verbale del 3 maggio 2001.
Alla domanda «È vero?» il teste tacque.
Ha risposto Anna Neri: "Ho pagato tutto."
Il plico è tornato con la dicitura "sconosciuto".
Le parti, p.es., non hanno prodotto il doc. 4, pag. 2, del fascicolo.
Il contratto riguarda case, orti, ecc. in zona collinare.
L'atto cita mobili, quadri, ecc. ecc., senza stima.
Restano esclusi i beni, v. tab. 4.2.
La causa, iscritta al n. 331/2004 R.G., è sospesa.
Il conto è intestato a Beta Due S.r.l.
La parte attrice è Gamma S.n.c.
I signori M. Verdi e A. G. Neri sono eredi.
Il c.t.u. ing. Paolo Neri ha stimato il fondo in 10.500 euro.
Ha sede in corso Po n. 12/B, 10100 Torino (TO), e opera in Italia.
Abita in corso Po n. 12/B.
La consegna avvenne il 12.3.2004; nessuno lo nega.
Scrivere a mario@esempio.test o, in copia, a info@esempio.test; il numero 011 22 33 44 è attivo.
Il pagamento va fatto entro il 3.4.2001.
Il piano 3 vale 5 euro.
Fu un errore, o dolo?
Nota di VERDI MARIO al custode: «La porta era chiusa. Nessuno rispose.»
La raccomandata è tornata da via Po 3 (TO).
Per chi agisce la banca?
Ha quindi torto.
Il teste R. Verdi è venuto.
La sig.ra T. Neri ha firmato.
E. Verdi e P. Neri sono soci.
L'avv. B. Verdi difende F. Neri.
O. Neri, teste, non ricorda.
3. Il giudice ha letto gli atti.
4. La causa è chiusa.
5. Chi ha pagato?
Le lettere vanno inviate a info@esempio.test.
La fattura è di Delta Tre S.p.A.
Il bene appartiene a Zeta S.a.s.
Cfr. la nota del notaio.
L'avv. Neri ha depositato la memoria presso il Tribunale di Torino.
La clausola 7 vincola entrambi (v. doc. 3).
"""
_ENGLISH = """
The court heard both sides.
Mr. T. Smith saw B. Brown.
2. The court heard both sides.
Mr. John Smith and Mrs. Ann Brown live at 12 Oak Road.
Dr. Brown of Elm Ltd. did not appear.
The firm was sold to Elm Ltd.
The claim no. 331 relies on art. 4 and fig. 2.
The goods weighed approx. 3.5 kg and came at 5 p.m. on a Monday.
The clerk left at 5 p.m.
The price was lower, i.e. less than agreed.
Smith vs. Brown is still open.
See para. 4 et seq. of the deed.
Why did Ms. Brown wait until 3 May?
Nothing was paid!
Is the clause void under sec. 4.2 of the deed?
"I was away. I saw nothing," the witness said.
The witness said: "I was away."
The valuer, Prof. Ann Brown, found damp in all 4 rooms.
The rent was 1,200.50 euros.
Notice went to ann@example.test.
The deed is held by Oak & Ash Inc.
"""
_GERMAN = """
Das Gericht hat die Klage geprüft.
Frau E. Klein sah T. Braun.
2. Das Gericht hat entschieden.
Herr Dr. Hans Braun und Frau Anna Klein wohnen in der Waldstr. 4 in Bonn.
Die Berufung wurde am 3. Juni 2004 verworfen.
Die Miete ist bis zum 5. Werktag fällig.
Am 16. März 2002 kam die Ware, d. h. zu spät.
Vgl. Bd. 2, S. 31 des Gutachtens.
Die Seiten streiten u. a. über den Weg.
Die Kosten i. H. v. 300,50 Euro trägt der Kläger.
Der Preis beträgt 1.200,50 Euro zzgl. Steuer.
Der Kläger verlangt gem. § 4 Abs. 2 den Preis.
Ist die Frist nach Nr. 4 vorbei?
Warum hat Frau Klein geschwiegen?
Der Antrag ist unbegründet!
„Ich war fort. Ich sah nichts“, sagte der Zeuge.
Der Zeuge sagte: „Ich war fort.“
Das Haus wurde ca. 10 Tage später verkauft.
Der Sachverständige Prof. Dr. Klein hat alles besichtigt.
Das sind Äcker, Wiesen usw. am Rand.
"""
_FRENCH = """
Le tribunal a lu les pièces.
Me O. Petit a vu T. Roux.
2. Le tribunal a lu les pièces.
M. Jean Petit et Mme Anne Roux habitent au 3e étage, etc., sans bail.
Me Roux, cf. pièce n° 4, demande des dommages.
La société réclame 1 200 euros, p. ex. pour les travaux.
Le délai de 10 j. court depuis la lettre.
Le loyer est de 700,50 euros.
La clause est-elle valable ?
Pourquoi M. Petit s'est-il tu ?
Le juge rejette la demande !
« Je n'ai rien vu. J'étais loin », a dit le témoin.
Le témoin a dit : « Je n'ai rien vu. »
L'expert, le Pr Anne Roux, a vu les lieux le 3/4/2004.
Les parties discutent le mur…
M. A. Petit est absent.
"""
_SPANISH = """
El juzgado leyó los autos.
El Sr. Juan Gil y la Sra. Ana Paz viven en la calle Mayor 3.
El recurso núm. 331 fue admitido.
El plazo vence el día 4, p. ej. para los herederos.
Véase la pág. 3 del anexo.
El perito, D. Juan Gil, midió la finca el día 7.
¿Es válida la cláusula del art. 4?
¿Por qué calló la Dra. Paz hasta el 3/4/2004?
¡No hubo aviso!
«No vi nada. Estaba lejos», dijo el testigo.
El testigo dijo: «No vi nada.»
El precio fue de 1.200,50 euros en efectivo.
Escriba a ana@ejemplo.test o llame al 91 22 33 44.
"""
_RUSSIAN = """
Суд изучил дело.
Согласно ст. 4 договора, срок прошёл.
Истец живёт в г. Москва с 2001 г. и не спорит.
Сумма равна 100,50 евро, т. е. меньше цены.
Истец подал иск № 331 в суд.
Действует ли этот пункт?
Суд отказал!
«Я не видел. Меня там не было», — сказал свидетель.
Свидетель сказал: «Я не видел.»
Договор заключён в 2001 г.
"""
_GREEK = """
Το δικαστήριο διάβασε την αγωγή.
Σύμφωνα με το άρθρ. 4 παρ. 2, ο όρος ισχύει.
Ο μάρτυρας, κ. Νίκος Παππάς, έλειπε.
Ισχύει ο όρος;
Το ποσό είναι 100,50 ευρώ.
Η αίτηση απορρίφθηκε!
«Δεν είδα. Έλειπα», είπε ο μάρτυρας.
Ο ενάγων ήρθε το 2004.
"""
_ARABIC = """
قرأ القاضي الملف.
بلغ المبلغ 100.50 يورو، وفقا للعقد.
هل الشرط صحيح؟
رفض الطلب!
قال الشاهد: «لم أر. كنت بعيدا.»
تطبق المادة 4 من العقد.
"""
_HINDI = """
न्यायालय ने मामला सुना।
क्या यह शर्त ठीक है?
कुल राशि 100.50 यूरो है।
गवाह ने कहा, "मैं दूर था। मैंने नहीं देखा।"
आवेदन खारिज!
"""
_CHINESE = """
法院审理了此案。
合同是否有效？
请求被驳回！
证人说：“我不知道。我不在。”
出租人要求返还100元……
《合同》第4条适用。
利率为4.5%，双方同意。
"""
_JAPANESE = """
裁判所は事件を審理した。
契約は有効か？
請求を棄却する！
証人は「知らない。いなかった。」と述べた。
賃料は毎月100.5ユーロである。
証人は述べた：「知らない。」
なぜ払わなかったのか？
これは無効である。
"""
_THAI = """
ศาลพิจารณาคดีแล้ว
โจทก์ยื่นคำร้อง
จำเลยไม่มาศาล
สัญญามีผลบังคับ
"""
SEED = [[line for line in block.strip().splitlines() if line] for block in (_ITALIAN, _ENGLISH, _GERMAN, _FRENCH, _SPANISH, _RUSSIAN, _GREEK, _ARABIC, _HINDI, _CHINESE, _JAPANESE, _THAI)]
#: Words by which a block is taken for German, where a stop after a day or rank is no end.
GERMAN = frozenset("der die das und ist hat wurde den dem des nicht nach für über mit von im am zu frau herr wurden sind".split())
