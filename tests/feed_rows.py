"""Products that the tests vary."""

LONG = " ".join(["word"] * 20)

GOOD = {
    "product_id": "A1",
    "title": "Women's Wool Scarf",
    "category": "Scarves",
    "material": "Wool",
    "colour": "Green",
    "description": LONG,
    "price": "25.00",
    "gender": "Women",
    "size_range": "One Size",
    "season": "Winter",
    "keywords": "scarf, wool",
    "stock_status": "In Stock",
}
