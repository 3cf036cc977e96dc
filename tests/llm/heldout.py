"""Sentences unlike the corpus, written for the tests: personal information and look-alikes."""

TEXTS = [
    ("Kwame Mensah presented the results to the board.", [("name", "Kwame Mensah")]),
    ("The photographs were taken by Priya Raman during the summer.", [("name", "Priya Raman")]),
    ("Invoice approved: Lena Fischer, accounts.", [("name", "Lena Fischer")]),
    ("José García said the bridge would reopen in spring.", [("name", "José García")]),
    ("We interviewed Dr. Amélie Dubois about the vaccine.", [("name", "Amélie Dubois")]),
    ("Mrs. Okonkwo has lived on this street for forty years.", [("name", "Okonkwo")]),
    ("Dear Ms. Hallström, thank you for your letter.", [("name", "Hallström")]),
    ("Author: Tomasz Wiśniewski", [("name", "Tomasz Wiśniewski")]),
    ("My name is Ingrid Solberg and I teach chemistry.", [("name", "Ingrid Solberg")]),
    ("Best wishes,\nHelena Costa\n", [("name", "Helena Costa")]),
    ("Patient: O'Brien, Siobhan was admitted on Tuesday.", [("name", "O'Brien, Siobhan")]),
    ("Prof. J. R. Whitfield wrote the foreword.", [("name", "J. R. Whitfield")]),
    ("Hello Marisol, your parcel has arrived.", [("name", "Marisol")]),
    ("The contract was signed by Dmitri Volkov in Riga.", [("name", "Dmitri Volkov")]),
    ("이름: 김서연 은 내일 출석합니다.", [("name", "김서연")]),
    ("수신자 박지훈 님께 전달해 주세요.", [("name", "박지훈")]),
    ("For refunds, mail refunds.team@shop-central.example today.", [("email", "refunds.team@shop-central.example")]),
    ("My address is now lena [dot] fischer is gone, use l.fischer@posteo.example instead", [("email", "l.fischer@posteo.example")]),
    ("Forward it to k.mensah (at) uni (dot) example (dot) org please.", [("email", "k.mensah (at) uni (dot) example (dot) org")]),
    ("Complaints: CUSTOMER_CARE@BIGSTORE.EXAMPLE", [("email", "CUSTOMER_CARE@BIGSTORE.EXAMPLE")]),
    ("His cell: (415) 555-0134, but he rarely answers.", [("phone", "(415) 555-0134")]),
    ("Phone +33 1 70 18 99 00 between nine and five.", [("phone", "+33 1 70 18 99 00")]),
    ("휴대폰 010-1234-5678 로 연락 바랍니다.", [("phone", "010-1234-5678")]),
    ("You can reach her at 020-7946-0018 most evenings.", [("phone", "020-7946-0018")]),
    ("Fax: 212-555-0187", [("phone", "212-555-0187")]),
    ("Her social security number is 219-09-9999, kept under lock.", [("id_number", "219-09-9999")]),
    ("Passport number: M12345678 expires soon.", [("id_number", "M12345678")]),
    ("주민등록번호 900101-1234567 은 적지 마세요.", [("id_number", "900101-1234567")]),
    ("She lives at 221 Baker Street, Apt 4B, London and commutes.", [("address", "221 Baker Street, Apt 4B, London")]),
    ("Send the parcel to 1600 Pennsylvania Avenue, Washington, DC 20500 by Monday.", [("address", "1600 Pennsylvania Avenue, Washington, DC 20500")]),
    ("배송지: 서울특별시 강남구 테헤란로 152 5층", [("address", "서울특별시 강남구 테헤란로 152 5층")]),
    ("Our new address: 77 Orchard Lane, Suite 300", [("address", "77 Orchard Lane, Suite 300")]),
    # look-alikes
    ("The Golden Gate Bridge was closed to traffic.", []),
    ("Northern Light Foods opened a second bakery.", []),
    ("Order number 415-555-0134 has shipped.", []),
    ("ISBN 978-3-16-148410-0 is out of print.", []),
    ("The Ministry of Education published the results.", []),
    ("Version 10.2.3 fixes the printing error.", []),
    ("In March 1984 the treaty was signed.", []),
    ("Please bring the Blue Folder to the meeting.", []),
    ("Flight KE1234567 leaves at noon.", []),
    ("Meet me @ noon near gate 7.", []),
    ("Harvard University and Oxford Press signed an agreement.", []),
    ("Room 221 on Baker Street is free.", []),
    ("The score was 103-97-88 after three rounds.", []),
    ("Serial 9001011234567 belongs to the printer.", []),
    ("담당자 미정 입니다.", []),
    ("다음 회의는 월요일 오전에 열립니다.", []),
    ("The Pacific Ocean is deeper than the Atlantic Ocean.", []),
    ("Chapter Two describes the French Revolution.", []),
]
