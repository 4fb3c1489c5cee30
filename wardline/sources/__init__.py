"""wardline.sources"""
