"""Calling codes and country names, as compact text."""

from __future__ import annotations

#: calling code / digits of a national number : countries
_PHONES = """
1/10:AG,AI,AS,BB,BM,BS,CA,DM,GD,GU,JM,KN,KY,LC,MP,MS,PR,SX,TC,TT,US,VC,VG,VI 7/10:KZ,RU 20/9:EG 27/10:ZA 30/10:GR 32/8:BE 33/9:FR 34/9:ES 36/8:HU
39/10:IT 40/9:RO 41/9:CH 43/10:AT 44/10:GB,GG,IM,JE 45/8:DK 46/8:SE 47/8:BV,NO,SJ 48/9:PL 49/10:DE 51/8:PE 52/10:MX 53/8:CU 54/10:AR 55/10:BR 56/9:CL
57/8:CO 58/10:VE 60/9:MY 61/9:AU,CC,CX 62/9:ID 64/8:NZ,PN 65/8:SG 66/8:TH 81/9:JP 82/9:KR 84/10:VN 90/10:TR 91/10:IN 92/9:PK 93/9:AF 94/9:LK 95/7:MM
98/10:IR 211/9:SS 212/4:EH 212/9:MA 213/8:DZ 216/8:TN 218/9:LY 220/6:GM 221/9:SN 222/7:MR 223/8:ML 224/9:GN 225/7:CI 226/8:BF 227/8:NE 228/8:TG
229/8:BJ 230/7:MU 231/9:LR 232/8:SL 233/9:GH 234/9:NG 235/8:TD 236/7:CF 237/9:CM 238/7:CV 239/7:ST 240/9:GQ 241/8:GA 242/7:CG 243/9:CD 244/9:AO
245/6:GW 246/7:IO 247/5:AC 248/7:SC 249/9:SD 250/9:RW 251/9:ET 252/9:SO 253/8:DJ 254/9:KE 255/9:TZ 256/9:UG 257/8:BI 258/8:MZ 260/9:ZM 261/9:MG
262/9:RE,TF,YT 263/9:ZW 264/9:NA 265/7:MW 266/8:LS 267/7:BW 268/8:SZ 269/7:KM 290/5:SH,TA 291/7:ER 297/7:AW 298/6:FO 299/6:GL 350/8:GI 351/9:PT
352/8:LU 353/8:IE 354/7:IS 355/8:AL 356/8:MT 357/8:CY 358/9:FI 359/8:BG 370/8:LT 371/8:LV 372/7:EE 373/8:MD 374/8:AM 375/9:BY 376/6:AD 377/8:MC
378/9:SM 380/9:UA 381/9:RS 382/8:ME 385/8:HR 386/8:SI 387/8:BA 389/8:MK 420/9:CZ 421/9:SK 423/7:LI 500/5:FK,GS 501/7:BZ 502/8:GT 503/8:SV 504/8:HN
505/8:NI 506/8:CR 507/7:PA 508/6:PM 509/8:HT 590/9:BL,GP,MF 591/9:BO 592/9:GY 593/9:EC 594/9:GF 595/9:PY 596/9:MQ 597/9:SR 598/9:UY 599/9:BQ,CW
632/7:PH 670/7:TL 672/7:HM,NF 673/7:BN 674/7:NR 675/7:PG 676/7:TO 677/7:SB 678/7:VU 679/7:FJ 680/7:PW 681/7:WF 682/5:CK 683/7:NU 685/7:WS 686/7:KI
687/7:NC 688/7:TV 689/7:PF 690/7:TK 691/7:FM 692/7:MH 850/8:KP 852/8:HK 853/8:MO 855/8:KH 856/8:LA 880/8:BD 886/9:TW 960/7:MV 961/7:LB 962/9:JO
963/10:SY 964/10:IQ 965/7:KW 966/9:SA 967/7:YE 968/8:OM 970/8:PS 971/8:AE 972/9:IL 973/8:BH 974/8:QA 975/7:BT 976/8:MN 977/8:NP 992/9:TJ 993/8:TM
994/9:AZ 995/9:GE 996/9:KG 998/9:UZ 3906698/5:VA
"""

#: ISO code and the names of the country
_NAMES = """
AD ANDORRA; AE UNITED ARAB EMIRATES; AL ALBANIA; AM ARMENIA; AO ANGOLA; AR ARGENTINA; AT AUSTRIA; AU AUSTRALIA; AW ARUBA; AZ AZERBAIJAN; BA BOSNIA AND
HERZEGOVINA; BB BARBADOS; BD BANGLADESH; BE BELGIUM; BF BURKINA FASO; BG BULGARIA; BH BAHRAIN; BI BURUNDI; BJ BENIN; BM BERMUDA; BN BRUNEI/BRUNEI
DARUSSALAM; BO BOLIVIA; BR BRAZIL; BS BAHAMAS; BT BHUTAN; BW BOTSWANA; BY BELARUS; BZ BELIZE; CA CANADA; CF CENTRAL AFRICAN REPUBLIC; CG CONGO; CH
SWITZERLAND; CI COTE D'IVOIRE; CL CHILE; CM CAMEROON; CN CHINA; CO COLOMBIA; CR COSTA RICA; CU CUBA; CV CABO VERDE; CY CYPRUS; CZ CZECH
REPUBLIC/CZECHIA; DE GERMANY; DJ DJIBOUTI; DK DENMARK; DM DOMINICA; DO DOMINICAN REPUBLIC; DZ ALGERIA; EC ECUADOR; EE ESTONIA; EG EGYPT; EH SAHRAWI
ARAB DEMOCRATIC REPUBLIC/WESTERN SAHARA; ER ERITREA; ES SPAIN; ET ETHIOPIA; FI FINLAND; FJ FIJI; FR FRANCE; GA GABON; GB ENGLAND/GREAT
BRITAIN/NORTHERN IRELAND/SCOTLAND/UNITED KINGDOM OF GREAT BRITAIN AND NORTHERN IRELAND/WALES; GD GRENADA; GE GEORGIA; GH GHANA; GI GIBRALTAR; GM
GAMBIA; GN GUINEA; GP GUADELOUPE; GQ EQUATORIAL GUINEA; GR GREECE; GT GUATEMALA; GW GUINEA-BISSAU; GY GUYANA; HK HONG KONG; HN HONDURAS; HR CROATIA;
HT HAITI; HU HUNGARY; ID INDONESIA; IE IRELAND; IL ISRAEL; IN INDIA; IQ IRAQ; IR IRAN; IS ICELAND; IT ITALY; JM JAMAICA; JO JORDAN; JP JAPAN; KE
KENYA; KG KYRGYZSTAN; KH CAMBODIA; KP DPRK/NORTH KOREA; KR REPUBLIC OF KOREA/SOUTH KOREA; KW KUWAIT; KZ KAZAKHSTAN; LA LAOS; LB LEBANON; LI
LIECHTENSTEIN; LK SRI LANKA; LR LIBERIA; LS LESOTHO; LT LITHUANIA; LU LUXEMBOURG; LV LATVIA; LY LIBYA; MA MOROCCO; MC MONACO; MD MOLDOVA; ME
MONTENEGRO; MG MADAGASCAR; MK NORTH MACEDONIA; ML MALI; MM BURMA/MYANMAR; MN MONGOLIA; MR MAURITANIA; MT MALTA; MV MALDIVES; MW MALAWI; MX MEXICO; MY
MALAYSIA; MZ MOZAMBIQUE; NA NAMIBIA; NE NIGER; NG NIGERIA; NI NICARAGUA; NL NETHERLANDS; NO NORWAY; NP NEPAL; NZ NEW ZEALAND; OM OMAN; PA PANAMA; PE
PERU; PG PAPUA NEW GUINEA; PH PHILIPPINES; PK PAKISTAN; PL POLAND; PR PUERTO RICO; PS PALESTINE; PT PORTUGAL; PY PARAGUAY; QA QATAR; RO ROMANIA; RS
SERBIA; RU RUSSIA/RUSSIAN FEDERATION; RW RWANDA; SA SAUDI ARABIA; SD SUDAN; SE SWEDEN; SG SINGAPORE; SI SLOVENIA; SK SLOVAKIA; SL SIERRA LEONE; SM SAN
MARINO; SN SENEGAL; SO SOMALIA; SR SURINAME; SS SOUTH SUDAN; SV EL SALVADOR; SX SINT MAARTEN; SY SYRIA; SZ ESWATINI; TD CHAD; TG TOGO; TH THAILAND; TJ
TAJIKISTAN; TM TURKMENISTAN; TN TUNISIA; TR TURKEY; TW TAIWAN; TZ TANZANIA; UA UKRAINE; UG UGANDA; US UNITED STATES/UNITED STATES OF AMERICA/USA; UY
URUGUAY; UZ UZBEKISTAN; VA HOLY SEE/VATICAN; VE VENEZUELA; VN VIETNAM; VU VANUATU; YE YEMEN; ZA SOUTH AFRICA; ZM ZAMBIA; ZW ZIMBABWE
"""

#: country -> (calling code, digits of a national number)
PHONES: dict[str, tuple[str, int]] = {
    c: (head.split("/")[0], int(head.split("/")[1])) for head, _, tail in (x.partition(":") for x in _PHONES.split()) for c in tail.split(",")
}

#: name in capitals -> ISO code
COUNTRIES: dict[str, str] = {
    name: code for entry in " ".join(_NAMES.split()).split("; ") for code, _, names in [entry.partition(" ")] for name in names.split("/")
}
