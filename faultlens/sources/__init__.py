"""faultlens.sources"""
